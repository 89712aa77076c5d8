"""Masks for text that changes at every visit, so that snapshots compare by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequern.functions.url import without_params

# What counts as volatile, in the order in which it is replaced. Look-arounds stand for word
# boundaries, since the JVM's \b takes other letters than ASCII for words and JavaScript's doesn't; the ad
# slot's last character is written apart for the same reason.
RELATIVE_TIME = r"(?<![A-Za-z0-9_])((?i:last updated|updated|posted))\s+(?i:about\s+)?\d+\s+(?i:seconds?|minutes?|hours?|days?)\s+(?i:ago)(?![A-Za-z0-9_])"
TIMESTAMP = r"(?<![A-Za-z0-9_])\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z(?![A-Za-z0-9_])"
TOKEN = r"(?i)(?<![A-Za-z0-9_])(?:csrf|xsrf|session|sid|nonce|token)=['\"]?[A-Za-z0-9._:-]{12,}['\"]?"
AD_SLOT = r"(?i)(?<![A-Za-z0-9_])(?:ad-slot|ad_unit|google_ads_iframe)[:=_-][A-Za-z0-9._-]{5,}[A-Za-z0-9_](?![A-Za-z0-9_])"
TRACKING_PARAM = "utm_[^=&#]*|fbclid|gclid|msclkid|yclid|mc_cid|mc_eid"
SESSION_PARAM = "session|sid|csrf|xsrf|nonce|token"

#: White space as JavaScript trims it.
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


#: A line without any of these has nothing to mask.
_TRIGGER = r"(?i)\sago|\d{4}-\d{2}-\d{2}T|(?:csrf|xsrf|session|sid|nonce|token)=|ad-slot|ad_unit|google_ads|https?://[^\s)]*\?"


def mask_volatile(line: Column) -> Column:
    """One trimmed line with relative times, timestamps, tokens, ad slots and tracking parameters masked.

    Inside a lambda nothing is shared between branches, so the chain names its input once: each replacement
    runs once, and only for lines that hold a trigger.
    """
    out = F.regexp_replace(line, RELATIVE_TIME, "$1 <relative-time>")
    out = F.regexp_replace(out, TIMESTAMP, "<timestamp>")
    out = F.regexp_replace(out, TOKEN, "token=<volatile-token>")
    out = F.regexp_replace(out, AD_SLOT, "ad-slot=<volatile-ad-slot>")
    mark = F.lit("\x01")
    out = F.regexp_replace(out, rf"(?i)(?<=[?&])(?:{TRACKING_PARAM})(?:=[^&#\s)]*)?(?=[&#\s)]|$)", "\x01")
    out = F.replace(F.replace(F.replace(out, F.lit("&\x01"), F.lit("")), F.lit("\x01&"), F.lit("")), F.lit("?\x01"), F.lit(""))
    out = F.regexp_replace(out, rf"(?i)(?<=[?&])({SESSION_PARAM})=[^&#\s)]*", "$1=<volatile-token>")
    return F.when(line.rlike(_TRIGGER), F.replace(out, mark, F.lit(""))).otherwise(line)


def mask_lines(lines: Column) -> Column:
    """Every line trimmed and masked, empty and NULL ones left out; NULL stays NULL."""
    pieces = F.flatten(F.transform(F.filter(lines, lambda x: x.isNotNull()), lambda x: F.split(x, "\r\n?|\n", -1)))
    trimmed = F.filter(F.transform(pieces, js_trim), lambda x: x != "")
    return F.transform(trimmed, mask_volatile)


def bare_link(url: Column) -> Column:
    """A link's URL without tracking and session parameters."""
    return F.when(F.instr(url, "?") > 0, without_params(url, f"{TRACKING_PARAM}|{SESSION_PARAM}")).otherwise(url)
