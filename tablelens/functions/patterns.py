"""Patterns and word lists that results depend on."""

# Patterns of the basic text check.
BASIC_PATTERNS = {
    "email_like": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_like": r"^\+?[\d\s\-\(\)]{10,}$",
    "url_like": r"^https?://[^\s/$.?#][^\s]*$",
}

# Fixed value: the URL pattern in its strict literal form, which takes one character before the first dot.
LITERAL_URL = r"^https?://[^\s/$\.?#]\.[^\s]*$"

# Patterns of personal data.
PII_PATTERNS = {
    "email_pattern": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_pattern": r"^\+?[\d\s\-\(\)]{10,}$",
    "ssn_pattern": r"^\d{3}-?\d{2}-?\d{4}$",
    "credit_card_pattern": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
    "ip_address_pattern": r"^(?:\d{1,3}\.){3}\d{1,3}$",
}

# Patterns of data formats; of equal ratios the first is dominant.
FORMAT_PATTERNS = {
    "masked_asterisk": r"\*{3,}",
    "masked_x": r"[xX]{3,}",
    "hex_string": r"^[0-9a-fA-F]{8,}$",
    "base64_like": r"^[A-Za-z0-9+/]{20,}=*$",
    "all_caps": r"^[A-Z][A-Z0-9_]*$",
    "camel_case": r"^[a-z][a-zA-Z0-9]*$",
    "snake_case": r"^[a-z][a-z0-9_]*$",
}

# Common patterns that inference tries first; the descriptions are free.
COMMON_PATTERNS = {
    "date_yyyy_mm_dd": (r"^\d{4}-\d{2}-\d{2}$", "year, month and day with hyphens"),
    "date_mm_dd_yyyy": (r"^\d{2}/\d{2}/\d{4}$", "month, day and year with slashes"),
    "date_dd_mm_yyyy": (r"^\d{2}/\d{2}/\d{4}$", "day, month and year with slashes"),
    "numeric_id": (r"^\d+$", "digits only"),
    "alphanumeric_id": (r"^[A-Z0-9]+$", "capitals and digits"),
    "mixed_case_id": (r"^[A-Za-z0-9]+$", "letters and digits"),
    "product_code": (r"^[A-Z]{1,3}\d{3,6}$", "one to three capitals, then three to six digits"),
    "license_plate": (r"^[A-Z]{1,3}\s?\d{1,4}$", "short capitals, then up to four digits, as on plates"),
    "email": (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "mail address"),
    "phone_basic": (r"^\d{10}$", "ten digits, as of a telephone"),
    "phone_formatted": (r"^\(\d{3}\)\s?\d{3}-\d{4}$", "telephone with the area in brackets"),
    "zip_code": (r"^\d{5}(-\d{4})?$", "five-digit postcode, with or without four more"),
    "postal_code": (r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$", "postcode of letters and digits in turn"),
    "currency": (r"^\$\d+(\.\d{2})?$", "amount in dollars"),
    "account_number": (r"^\d{8,12}$", "eight to twelve digits"),
    "single_word": (r"^[A-Za-z]+$", "one word of letters"),
    "capitalized_word": (r"^[A-Z][a-z]+$", "one word with a capital first"),
    "all_caps": (r"^[A-Z]+$", "capitals only"),
    "title_case": (r"^[A-Z][a-z]+(\s[A-Z][a-z]+)*$", "words with capitals first"),
    "version_number": (r"^\d+\.\d+(\.\d+)?$", "two or three numbers with points"),
    "ip_address": (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "four numbers with points"),
    "hex_color": (r"^#[0-9A-Fa-f]{6}$", "colour in hexadecimal"),
}

# Regexes of character compositions.
COMPOSITION_PATTERNS = {
    "all_digits": r"^\d+$",
    "all_uppercase": r"^[A-Z]+$",
    "all_lowercase": r"^[a-z]+$",
    "title_case": r"^[A-Z][a-z]*$",
    "mixed_case_letters": r"^[A-Za-z]+$",
    "alphanumeric": r"^[A-Za-z0-9]+$",
}

# Separators of structured values, tried in this order.
SEPARATORS = ("-", "/", "_", ".", " ", ":", ";", ",")
