"""Several values packed in one field: one row per value with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.text import trim_all

#: Ends of a placeholder. A text that holds them is still restored: each is masked as a span of its own.
OPEN, CLOSE = "\x01", "\x02"
#: Spans within which delimiters don't separate. Possessive, so that an unclosed quote costs no backtracking.
DOUBLED = r'"[^"]*+(?:""[^"]*+)*+"'
ESCAPED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Levels of comments within comments that are masked as one; deeper ones are masked level by level from the inside only.
COMMENT_DEPTH = 8


def _comment(depth: int) -> str:
    inner = f"|{_comment(depth - 1)}" if depth > 1 else ""
    return rf"\((?:[^()\\]++|\\.{inner})*+\)"


COMMENT = _comment(COMMENT_DEPTH)
ANGLE = r"<[^<>]*+>"
ADDRESS = r"[^\s<>()\[\],;:@\"]+@[^\s<>()\[\],;:@\"]+"


def mask(text: Column, span: str) -> tuple[Column, Column]:
    """(masked text, spans): every match of ``span`` replaced by OPEN index CLOSE."""
    pattern = f"(?s){span}|[{OPEN}{CLOSE}]"
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    marked = F.transform(parts, lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p))
    return F.array_join(marked, ""), spans


def restore(piece: Column, spans: Column) -> Column:
    """The piece with its placeholders replaced by their spans."""
    bits = F.split(piece, OPEN, -1)
    return F.array_join(
        F.transform(bits, lambda b, i: F.when(i == 0, b).otherwise(F.concat(F.try_element_at(spans, F.substring_index(b, CLOSE, 1).cast("int") + 1), F.substring(b, F.locate(CLOSE, b) + 1, F.length(b))))),
        "",
    )


def unquote(c: Column) -> Column:
    """A trimmed text without enclosing double quotes; a doubled quote inside stands for one."""
    t = trim_all(c)
    inner = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.regexp_like(t, F.lit(r'(?s)\A".*"\z')) & (F.length(t) >= 2), inner).otherwise(t)


def split_values(text: Column, delimiters: str = r"[,;|\t\r\n]", span: str = DOUBLED) -> Column:
    """array<string>: the values of a packed text in order, unquoted, without empty ones; null gives null."""
    masked, spans = mask(text, span)
    return F.filter(F.transform(F.split(masked, delimiters, -1), lambda p: unquote(restore(p, spans))), lambda v: v != "")


def split_addresses(text: Column) -> Column:
    """array<string>: the mail address of each entry of an address list in lower case; entries without one are left out.

    Quoted names, comments and angle brackets are masked first. An entry's address is the one in angle brackets if there
    is one, else the bare one; a group's name is dropped, so that it counts by its members. A line end separates entries
    unless the next line is indented (a folded line).
    """
    masked, spans = mask(text, f"{ESCAPED}|{COMMENT}|{ANGLE}")
    holder = f"{OPEN}[0-9]+{CLOSE}"

    def span_of(h: Column) -> Column:
        return F.try_element_at(spans, F.substring(h, F.lit(2), F.length(h) - 2).cast("int") + 1)

    def angled(p: Column) -> Column:
        inner = F.transform(F.filter(F.transform(F.regexp_extract_all(p, F.lit(holder), F.lit(0)), span_of), lambda s: s.startswith("<")), lambda s: trim_all(F.substring(s, F.lit(2), F.length(s) - 2)))
        return F.filter(inner, lambda s: s.contains("@"))

    def bare(p: Column) -> Column:
        plain = F.regexp_replace(p, r"\A[^:@]*+:", "")
        kept = F.regexp_extract_all(plain, F.lit(rf"(?:{holder})?[^\s<>()\[\],;:@\"{OPEN}{CLOSE}]*@[^\s<>()\[\],;:@\"{OPEN}{CLOSE}]+"), F.lit(0))
        whole = F.transform(kept, lambda k: F.when(F.regexp_like(k, F.lit(rf"\A{holder}@")), restore(k, spans)).otherwise(F.regexp_replace(k, rf"\A{holder}", "")))
        return F.filter(whole, lambda s: ~s.startswith("@"))

    def entry(p: Column) -> Column:
        return F.when(F.size(angled(p)) > 0, angled(p)).otherwise(bare(p))

    pieces = F.transform(F.split(masked, r"[,;|]|[\r\n]+(?![ \t\r\n])", -1), lambda p: F.regexp_replace(p, r"[\r\n\t]+", " "))
    return F.transform(F.flatten(F.transform(pieces, entry)), lambda a: F.lower(a))


def explode_packed(df: DataFrame, values: Column, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per value with its position from 1; rows whose list is null or empty yield none."""
    kept = df.columns
    return df.select(*[F.col(f"`{c}`") for c in kept if c not in (value, pos)], F.posexplode(values).alias("__pos", value)).select(
        *[F.col(f"`{c}`") for c in kept if c not in (value, pos)], (F.col("__pos") + 1).cast("bigint").alias(pos), value
    )
