"""Scalar normalisation: addresses, phones, names, domains, subjects, click ids. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
DOTLESS_DOMAINS = ("gmail.com", "googlemail.com")
FAKE_PHONES = (*(str(d) * 10 for d in range(10)), "1234567890", "0123456789")
NULL_STRINGS = ("null", "NULL", "None", "none", "")
ENTITIES = (("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#160;", " "))
CLICK_IDS = ("fbclid", "gclid", "ttclid", "li_fat_id")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_email(c: Column) -> Column:
    """Lower-case trimmed address, without dots in the local part of dot-blind domains; null if it is none."""
    e = F.lower(F.trim(c))
    local, domain = F.split_part(e, F.lit("@"), F.lit(1)), F.split_part(e, F.lit("@"), F.lit(2))
    return F.when(F.regexp_like(e, F.lit(EMAIL)), F.when(domain.isin(*DOTLESS_DOMAINS), F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@"), domain)).otherwise(e))


def norm_phone(c: Column) -> Column:
    """The trimmed phone text; null if empty, an address or a known fake."""
    t = F.trim(c)
    return F.when((t != "") & ~t.contains("@") & ~t.isin(*FAKE_PHONES), t)


def mail_address(c: Column) -> Column:
    """The address of ``Name <address>``, else the trimmed text."""
    return F.when(c.contains("<") & c.contains(">"), F.regexp_extract(c, r"<([^>]+)>", 1)).otherwise(F.trim(c))


def mail_name(c: Column) -> Column:
    """The display name before ``<``; null without one."""
    return empty_to_null(F.trim(F.regexp_extract(c, r"^([^<]+)<", 1)))


def unquoted(c: Column) -> Column:
    """A display name without quotes around it."""
    return empty_to_null(F.trim(F.regexp_replace(c, r"^[\"']+|[\"']+$", "")))


def redirected_domain(c: Column) -> Column:
    """The twin of a domain: without ``www.`` if it has it, else with it."""
    return F.when(c.startswith("www."), F.substring(c, 5, 1_000_000)).otherwise(F.concat(F.lit("www."), c))


def html_decode(c: Column) -> Column:
    """Common entities decoded one after the other; null gives ''."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.coalesce(c, F.lit("")))


def null_safe_cast(c: Column, kind: str) -> Column:
    """try_cast with null-like text as null."""
    return F.when(~c.cast("string").isin(*NULL_STRINGS), c.cast("string").try_cast(kind))


def format_fbc(click: Column, at: Column) -> Column:
    """``fb.1.<epoch ms>.<click id>`` where both are known."""
    return F.concat(F.lit("fb.1."), F.unix_millis(at.cast("timestamp")).cast("string"), F.lit("."), click)


def clean_subject(c: Column) -> Column:
    """A subject without up to four reply and forward prefixes."""
    return F.trim(F.regexp_replace(c, r"^(([Rr][Ee]|[Ff][Ww][Dd]?):\s*){1,4}", ""))


def click_id(query: Column, name: str) -> Column:
    """A click id of a query string."""
    return empty_to_null(F.regexp_extract(query, rf"[?&]{name}=([^&#]+)", 1))


def case_map(c: Column, mapping: dict[str, Column | str], default: Column | str | None = None) -> Column:
    """CASE c WHEN key THEN value ... ELSE default; texts are SQL expressions."""
    as_col = lambda v: F.expr(v) if isinstance(v, str) else v
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, as_col(v)) if out is None else out.when(c == k, as_col(v))
    rest = as_col(default) if default is not None else F.lit(None)
    return rest if out is None else out.otherwise(rest)


def domain_filter(c: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Non-empty domains, of the include list if there is one, not of the exclude list."""
    ok = c.isNotNull() & (c != "")
    if include:
        ok = ok & c.isin(*include)
    return ok & ~c.isin(*exclude) if exclude else ok


def label_of(c: Column) -> Column:
    """``some_name`` -> ``Some Name``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def channel(source: Column, referrer: Column, search: Column, exclusions: list[str] | tuple[str, ...] = ()) -> Column:
    """paid, social, organic, referral or direct; exclusions are LIKE patterns of referrers that don't count."""
    ref = referrer.isNotNull()
    for p in exclusions:
        ref = ref & ~referrer.like(p)
    return (
        F.when(source.isNotNull(), "paid")
        .when(referrer.like("%facebook%") | search.like("%fbclid%"), "social")
        .when(referrer.like("%google%"), "organic")
        .when(ref, "referral")
        .otherwise("direct")
    )
