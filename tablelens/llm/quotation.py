"""Chat formatting by quotation linking.

Quoted lines (``>`` and deeper) are parsed into passages, one per run of lines of one level. Passages and lines are
hashed in normal form (lower case, single spaces) and joined to the unquoted lines of earlier messages of the same
conversation; the message that matches most, the latest of equals, is the one replied to. Messages come out without
their quotes, with the message they reply to and the start of their thread, so that ordering by (conv_id, root_turn,
turn) gives reply-ordered conversations.

Nulls: a null text is an empty message; a null conv_id is a conversation of its own; a message with a null turn is
neither linked nor linked to. Repeated rows each give a row. Lines that repeat in many messages are matched with the
latest earlier message only, found by windows over blocks of turns, so no pairs are formed. Empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, only, text_or_empty

QUOTE = r"^[ \t]*>"
PREFIX = r"^([ \t]*>)+"
#: A line that introduces a quote, as mail programs write it.
ATTRIBUTION = r"(?i)^\s*(on|le|am|el)\b.{0,200}\b(wrote|écrit|schrieb|escribió)\s*:\s*$"
#: Turns are searched in blocks of this many; the latest of each earlier block is carried over.
BLOCK = 4096


def lines_of(text: Column) -> Column:
    """struct(level, body) of every line."""
    return F.transform(
        F.split(text, r"\r\n|\r|\n"),
        lambda x: F.struct(
            F.char_length(F.regexp_replace(F.regexp_extract(x, PREFIX, 0), r"[ \t]", "")).alias("level"),
            F.regexp_replace(x, PREFIX, "").alias("body"),
        ),
    )


def normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[\s ]+", " "))


def _own(lines: Column) -> Column:
    """The message without quotes and without the line that introduces one."""
    shifted = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
    marked = F.zip_with(
        lines,
        shifted,
        lambda x, y: F.struct(
            x["body"].alias("body"), ((x["level"] > 0) | (x["body"].rlike(ATTRIBUTION) & (F.coalesce(y["level"], F.lit(0)) > 0))).alias("out")
        ),
    )
    kept = F.transform(F.filter(marked, lambda x: ~x["out"]), lambda x: x["body"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, lines (null where nothing is quoted) of every message."""
    m = only(messages, "conv_id", "turn", "role", "text").withColumn("text", text_or_empty(F.col("text").cast("string")))
    quoted = F.col("text").rlike(r"(?m)" + QUOTE)
    return m.select(
        "conv_id", "turn", "role", F.when(quoted, _own(lines_of(F.col("text")))).otherwise(F.col("text")).alias("content"),
        F.when(quoted, lines_of(F.col("text"))).alias("lines"),
    )


def quoted_units(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, unit, weight: hashes of quoted lines, and of whole passages of several lines.

    A passage is a run of lines of one level; it starts where the level changes. The work grows with the lines.
    """
    # Written, as the runs look lines up by place.
    source = materialise(parsed.where("lines is not null and turn is not null").select("conv_id", "turn", "lines"), "quoted")
    level = lambda i: F.get("lines", i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    found = source.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts") - 1), F.array(F.size("lines")))
    body = lambda a, b: F.array_join(F.transform(F.slice("lines", a + 1, b - a), lambda x: x["body"]), "\n")
    runs = F.zip_with("starts", ends, lambda a, b: F.struct(level(a).alias("level"), body(a, b).alias("body")))
    lines = source.select("conv_id", "turn", F.explode("lines").alias("q"), F.lit(1).alias("weight"))
    whole = found.select("conv_id", "turn", F.explode(runs).alias("q"), F.lit(1000).alias("weight"))
    units = lines.unionByName(whole.where("q.body like '%\n%'")).where("q.level > 0")
    units = units.select("conv_id", "turn", F.col("q.level").alias("level"), normal(F.col("q.body")).alias("n"), "weight").where("n <> ''")
    return units.select("conv_id", "turn", "level", F.md5("n").alias("unit"), "weight").distinct()


def link(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_quotes, n_linked of every message that quotes."""
    units = materialise(quoted_units(parsed), "quotes")
    counts = units.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"))
    quoting = units.select("conv_id").distinct().alias("q")
    here = parsed.alias("p").join(quoting, F.expr("p.conv_id <=> q.conv_id"), "left_semi").where("turn is not null")
    bodies = F.filter(F.split("content", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    originals = here.select("conv_id", "turn", F.explode(F.array_union(F.array(F.col("content")), bodies)).alias("body"))
    originals = originals.select("conv_id", "turn", F.md5(normal(F.col("body"))).alias("unit")).where(F.col("unit") != F.md5(F.lit(""))).distinct()
    block = F.floor(F.col("turn") / BLOCK)
    # Both kinds of rows in one order; each quote sees the latest original before it in its block, else of earlier ones.
    asked = units.select("conv_id", "unit", "turn", block.alias("block"), "level", "weight", F.lit(None).cast("long").alias("origin"))
    given = originals.select(
        "conv_id", "unit", "turn", block.alias("block"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("weight"),
        F.col("turn").cast("long").alias("origin"),
    )
    near = Window.partitionBy("conv_id", "unit", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = asked.unionByName(given).withColumn("near", F.max("origin").over(near)).where("weight is not null")
    blocks = asked.select("conv_id", "unit", "block").unionByName(given.select("conv_id", "unit", "block")).distinct()
    latest = given.groupBy("conv_id", "unit", "block").agg(F.max("origin").alias("last"))
    same = ["conv_id", "unit", "block"]
    by_key = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in same))
    earlier = Window.partitionBy("conv_id", "unit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.alias("b").join(latest.alias("l"), by_key("b", "l"), "left").select("b.*", "l.last")
    carried = carried.select(*same, F.max("last").over(earlier).alias("far"))
    hits = found.alias("f").join(carried.alias("c"), by_key("f", "c"), "left").select("f.*", F.coalesce("f.near", "c.far").alias("source")).where("source is not null")
    score = hits.groupBy("conv_id", "turn", "level", "source").agg(F.sum("weight").alias("w"))
    # The message replied to is the best match of the shallowest level that has any.
    best = score.groupBy("conv_id", "turn").agg(
        F.min(F.struct("level", (-F.col("w")).alias("w"), (-F.col("source")).alias("s"))).alias("b"), F.count(F.lit(1)).alias("n_linked")
    )
    out = counts.alias("k").join(best.alias("b"), F.expr("k.conv_id <=> b.conv_id and k.turn = b.turn"), "left")
    return out.select("k.conv_id", "k.turn", (-F.col("b.b.s")).alias("parent_turn"), "k.n_quotes", F.coalesce("b.n_linked", F.lit(0)).cast("long").alias("n_linked"))


def thread_roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of every linked message, by doubling jumps along replies."""
    t = materialise(links.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "threads")
    while True:
        a, b = t.alias("a"), t.alias("b")
        jumped = a.join(b, F.expr("a.conv_id <=> b.conv_id and a.root_turn = b.turn"), "left").select(
            "a.conv_id", "a.turn", F.coalesce("b.root_turn", "a.root_turn").alias("root_turn"),
            (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"), F.col("b.turn").isNotNull().alias("moved"),
        )
        jumped = materialise(jumped, "threads")
        t = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return t


def format_chat(messages: DataFrame) -> DataFrame:
    """Every message without quotes: conv_id, root_turn, turn, parent_turn, depth, role, content, n_quotes, n_linked."""
    parsed = parse(messages)
    links = materialise(link(parsed), "links")
    roots = thread_roots(links)
    m, k, r = parsed.alias("m"), links.alias("k"), roots.alias("r")
    out = m.join(k, F.expr("m.conv_id <=> k.conv_id and m.turn = k.turn"), "left").join(r, F.expr("m.conv_id <=> r.conv_id and m.turn = r.turn"), "left")
    return out.select(
        "m.conv_id", F.coalesce("r.root_turn", "m.turn").cast("long").alias("root_turn"), F.col("m.turn").cast("long").alias("turn"), "k.parent_turn",
        F.coalesce("r.depth", F.lit(0)).alias("depth"), "m.role", "m.content", F.coalesce("k.n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("k.n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def render(formatted: DataFrame) -> DataFrame:
    """Chat markup of every message, to be read in the order of (conv_id, root_turn, turn)."""
    mark = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("content"), F.lit("\n"))
    return formatted.select("conv_id", "root_turn", "turn", mark.alias("segment"))
