"""Column expressions for text: stripping, tokens, labels and their readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, for use inside a character class; the same set in Java, RE2 and str.strip().
WS = r"\t-\r\x1C-\x1F\x{85}\p{Z}"
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    """Texts that neither begin nor end with white space, which are most, are not searched."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(f"[{WS}]"), F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")).otherwise(c)


def squeeze(c: Column, by: str = " ") -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, rf"[{WS}]+", by)


def word_count(c: Column) -> Column:
    bare = strip(squeeze(F.coalesce(c, F.lit(""))))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def has_words(c: Column, n: int) -> Column:
    """word_count(c) >= n, without reading on after the nth word."""
    return F.coalesce(c, F.lit("")).rlike(rf"^[{WS}]*+(?:[^{WS}]++[{WS}]++){{{n - 1}}}[^{WS}]")


#: Letters that full case folding turns into several.
FOLDED = {"ß": "ss", "ŉ": "ʼn", "ǰ": "ǰ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def fold(c: Column) -> Column:
    """Full case folding of Latin and Greek: lower case, with the letters that it makes other or more letters spelled out. Rarer ones (Armenian, Cherokee) are only made small."""
    out = F.translate(F.lower(c), "ſςẞµ", "sσßμ")
    for one, many in FOLDED.items():
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


def tokens(c: Column) -> Column:
    """Words and single other signs, case-folded."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(rf"([{WORD}]+|[^{WORD}{WS}])"), F.lit(1))


def strip_markdown(c: Column) -> Column:
    bare = F.regexp_replace(c, rf"^#{{1,6}}[{WS}]+", "")
    for mark in (r"\*\*(.+?)\*\*", r"\*(.+?)\*"):
        bare = F.regexp_replace(bare, mark, "$1")
    return strip(bare)


def repeat_key(c: Column) -> Column:
    """What is left of a running header when page numbers change."""
    return F.lower(strip(F.regexp_replace(squeeze(c), rf"{DIGIT}+", "#")))


#: Labels at the start of a line, tried in this order: (pattern of label, what may follow, level; None: by dots, 0: by context). Fixed values.
LINE_LABELS = (
    (rf"({DIGIT}+(?:\.{DIGIT}+)+)", rf"\.?[{WS}]+", None),
    (rf"({DIGIT}+)", rf"\.[{WS}]+", 1),
    (rf"(?:Section|SECTION|第)[{WS}]*({DIGIT}+(?:\.{DIGIT}+)*)", rf"[{WS}]*[条节章]?[{WS}]*", None),
    (rf"(?:Article|ARTICLE)[{WS}]+([IVXLC]+|{DIGIT}+)", rf"[{WS}]*\.?[{WS}]+", 1),
    (r"(\([a-z]\))", rf"[{WS}]*", 0),
    (r"(\([ivx]+\))", rf"[{WS}]*", 0),
    (rf"(\({DIGIT}+\))", rf"[{WS}]*", 0),
    (r"([A-Z])", rf"\.[{WS}]+", 0),
)
DECIMAL = rf"^{DIGIT}+(\.{DIGIT}+)*$"


def line_label(c: Column) -> Column:
    """struct(label, title, level): the first label pattern that the line begins with; ('', c, null) without one."""
    out = F.struct(F.lit("").alias("label"), c.alias("title"), F.lit(None).cast("int").alias("level"))
    for label, after, level in reversed(LINE_LABELS):
        whole = rf"(?s)^{label}{after}([^{WS}].*)$"
        found = F.regexp_extract(c, whole, 1)
        how = F.lit(level) if level else F.size(F.split(found, r"\.")) if level is None else F.lit(None)
        out = F.when(c.rlike(whole), F.struct(found.alias("label"), strip(F.regexp_extract(c, whole, 2)).alias("title"), how.cast("int").alias("level"))).otherwise(out)
    return out


#: A label of the block outline and its title, Roman numbers, decimal labels.
BLOCK_LABEL = rf"(?s)^({DIGIT}+(?:\.{DIGIT}+)*[.)]?|\([A-Za-z0-9]+\)|[A-Za-z]+[.)])[{WS}]+(.+)$"
ROMAN = r"^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def bare_label(c: Column) -> Column:
    return F.regexp_replace(c, r"^[().]+|[().]+$", "")


def numeric_depth(label: Column) -> Column:
    bare = bare_label(label)
    return F.when(bare.rlike(DECIMAL), F.size(F.split(bare, r"\.")))


def label_grammar(label: Column) -> Column:
    return F.when(label.rlike("[A-Za-z]"), "ambiguous").otherwise("numeric_or_raw")


def roman_value(token: Column) -> Column:
    """Value of a well-formed Roman number, else null: each sign counts, less twice the smaller sign before a larger one."""
    up = F.upper(token)
    worth = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    values = F.transform(F.split(up, "(?<=.)(?=.)"), lambda s: F.coalesce(worth[s], F.lit(0)))
    total = F.aggregate(
        values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, v: F.struct((acc["sum"] + v - F.when(acc["last"] < v, 2 * acc["last"]).otherwise(0)).alias("sum"), v.alias("last")),
        lambda acc: acc["sum"],
    )
    return F.when(up.rlike(ROMAN), total)


#: Numbers of up to 38 digits; longer ones read as null in value and path, while the series keeps all digits.
NUMBER = "decimal(38,0)"
READING = f"struct<family:string,value:{NUMBER},series:string,path:array<{NUMBER}>>"


def label_readings(label: Column) -> Column:
    """What a label may count: a number path, a letter, a Roman number; a token may have both of the last two."""
    bare, last = bare_label(label), F.substring(label, -1, 1)
    ending = F.when(label.startswith("("), "parenthesized").when(last.isin(".", ")"), last).otherwise("bare")
    case = F.when((F.upper(bare) == bare) & (F.lower(bare) != bare), "upper").otherwise("lower")
    digits = F.transform(F.split(bare, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    parts = F.transform(digits, lambda x: x.try_cast(NUMBER))
    front = F.concat(F.lit("["), F.array_join(F.slice(digits, 1, F.greatest(F.size(digits) - 1, F.lit(0))), ", "), F.lit("]"))
    none = F.lit(None).cast(f"array<{NUMBER}>")
    reading = lambda family, value, series, path: F.struct(F.lit(family).alias("family"), value.cast(NUMBER).alias("value"), series.alias("series"), path.alias("path"))
    number = F.array(reading("numeric", F.element_at(parts, -1), F.concat(F.lit("numeric:"), ending, F.lit(":"), front), parts))
    letter = F.when(bare.rlike("^[A-Za-z]$"), reading("alpha", F.ascii(F.lower(bare)) - 96, F.concat_ws(":", F.lit("alpha"), case, ending), none))
    roman = F.when(roman_value(bare).isNotNull(), reading("roman", roman_value(bare), F.concat_ws(":", F.lit("roman"), case, ending), none))
    others = F.filter(F.array(letter, roman), lambda x: x.isNotNull())
    return F.when(bare.rlike(DECIMAL), number).otherwise(others).cast(f"array<{READING}>")
