"""Text cleaning as native column expressions.

The character classes follow Unicode: a word character is a letter, a number or an
underscore, and white space includes the four ASCII separator controls. Java's own
``\\w`` and ``\\s`` are ASCII-only, hence the explicit classes.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"

URL = rf"(?Ui)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
MENTION = rf"@{WORD}+"
# The word after the marker goes too, with or without "@": that is the documented quirk.
RETWEET_PREFIX = (
    rf"(?Ui)rt(?<!{WORD}rt){SPACE}*:?{SPACE}*@?{WORD}*{SPACE}*:?{SPACE}*"
)
RETWEET_PREFIX_STRICT = (
    rf"(?Ui)rt(?<!{WORD}rt)(?!{WORD}){SPACE}*:?{SPACE}*@{WORD}+{SPACE}*:?{SPACE}*"
)
RETWEET_WORD = rf"(?Ui)rt(?<!{WORD}rt)(?!{WORD}){SPACE}*:?{SPACE}*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and all-white-space text; stops at the first other character."""
    return ~or_empty(c).rlike(rf"(?U){NOT_SPACE}")


def strip(c: Column | str) -> Column:
    """Cut white space of any kind at both ends (``trim`` alone cuts blanks only)."""
    return F.regexp_replace(_col(c), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def collapse_ws(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), rf"(?U){SPACE}+", " "))


def clean_text(c: Column | str) -> Column:
    """Collapse white space and trim; null becomes the empty string."""
    return collapse_ws(or_empty(c))


def strip_urls(c: Column | str) -> Column:
    """Replace URLs by a blank. The substring test spares most rows the regex."""
    c = _col(c)
    candidate = c.contains("://") | F.lower(c).contains("www.")
    return F.when(candidate, F.regexp_replace(c, URL, " ")).otherwise(c)


def strip_mentions(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.contains("@"), F.regexp_replace(c, MENTION, " ")).otherwise(c)


def strip_retweets(c: Column | str, strict: bool = False) -> Column:
    """Replace retweet prefixes by a blank.

    The default also eats the word that follows, and whole words that begin with "rt".
    ``strict`` removes only a marker that is followed by a mention.
    """
    return F.regexp_replace(_col(c), RETWEET_PREFIX_STRICT if strict else RETWEET_PREFIX, " ")


def strip_retweet_words(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), RETWEET_WORD, " ")


def strip_escape_sequences(c: Column | str) -> Column:
    """Replace the two-character sequences ``\\n``, ``\\r`` and ``\\t`` by blanks."""
    out = _col(c)
    for sequence in ("\\n", "\\r", "\\t"):
        out = F.replace(out, F.lit(sequence), F.lit(" "))
    return out


def strip_escapes(c: Column | str) -> Column:
    """The same for the sequences and for the real characters."""
    return F.translate(strip_escape_sequences(c), "\n\r\t", "   ")


def decode_entities(c: Column | str) -> Column:
    """Decode HTML entities twice. Rows without "&" send only a null through Arrow."""
    @F.pandas_udf(T.StringType())
    def unescape_twice(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(html.unescape(t)), na_action="ignore")

    c = _col(c)
    return F.coalesce(unescape_twice(F.when(c.contains("&"), c)), c)


def decode_core_entities(c: Column | str) -> Column:
    """The native path for inputs known to hold only the five core entities."""
    out = _col(c)
    for _ in range(2):
        for entity, char in (
            ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
        ):
            out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def clean_tweet(
    c: Column | str, entities: str = "full", strict_retweets: bool = False
) -> Column:
    """The training-text chain: entities, URLs, retweets, mentions, escapes, white space.

    ``entities`` is ``full`` (one Arrow UDF), ``core`` (native) or ``none``. The
    non-strict prefix pattern removes every stand-alone marker, so the separate
    marker pass is only needed in strict mode.
    """
    decoders = {"full": decode_entities, "core": decode_core_entities, "none": lambda x: x}
    out = decoders[entities](or_empty(c))
    out = strip_retweets(strip_urls(out), strict_retweets)
    out = strip_mentions(out)
    if strict_retweets:
        out = strip_retweet_words(out)
    # Collapsing also takes care of the real line breaks and tabs.
    return collapse_ws(strip_escape_sequences(out))


def normalize_text(c: Column | str) -> Column:
    """URLs and mentions out, white space collapsed; null becomes the empty string."""
    return collapse_ws(strip_mentions(strip_urls(or_empty(c))))


def is_blank_normalized(c: Column | str) -> Column:
    """True when ``normalize_text`` leaves nothing.

    Only a text that is blank or opens with a link or a mention can end up empty, so
    the full normalisation runs for those alone. That matters in a filter, which is
    pushed below the projection that normalises and would run everything twice.
    """
    opens = or_empty(c).rlike(rf"(?Ui)\A{SPACE}*+(?:\z|@|https?://|www\.)")
    return opens & (normalize_text(c) == "")


def rule_text(c: Column | str) -> Column:
    """Lower-case text reduced to ASCII letters, digits, apostrophes and hyphens."""
    kept = F.regexp_replace(F.lower(or_empty(c)), r"(?U)[^a-zA-Z0-9\s\x1c-\x1f'-]", " ")
    return collapse_ws(kept)


def words(c: Column | str) -> Column:
    """All lower-case words of the whole text."""
    return F.filter(F.split(F.lower(or_empty(c)), NON_WORD_RUN), lambda w: w != "")


def words_in(c: Column | str, vocabulary) -> Column:
    """The words of the whole text that belong to a fixed vocabulary, with repeats."""
    vocabulary = sorted(vocabulary)
    return F.filter(
        F.split(F.lower(or_empty(c)), NON_WORD_RUN), lambda w: w.isin(vocabulary)
    )


def has_words(c: Column | str, n: int) -> Column:
    """At least ``n`` white-space separated words; reads no further than those."""
    lead = rf"(?:{NOT_SPACE}++{SPACE}++){{{n - 1}}}" if n > 1 else ""
    return or_empty(c).rlike(rf"(?U)\A{SPACE}*+{lead}{NOT_SPACE}")


def preview(c: Column | str, length: int = 60, ellipsis: str = "...") -> Column:
    c = _col(c)
    return F.when(
        F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(ellipsis))
    ).otherwise(c)


def iso_date_prefix(c: Column | str) -> Column:
    return F.substring(_col(c), 1, 10)


def display_label(c: Column | str) -> Column:
    """``severe_toxic`` → ``Severe Toxic``."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def resolve_language(text: Column | str, detected: Column | str) -> Column:
    """The detected language, or ``en`` for short texts and failed detection."""
    known = F.coalesce(_col(detected), F.lit("en"))
    return F.when(has_words(text, 4), known).otherwise(F.lit("en"))
