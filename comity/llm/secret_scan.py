"""Operator 8: secret scans whose false positives a random forest removes.

A word between white space gives one candidate for each of these, over every whole text:

- a value assigned to a credential name, of any length and with digits or not: in the word, or
  in the words after the name; in quotes all to the closing quote,
- the password of an address (``scheme://user:password@host``),
- every run of LEAST characters or more that keys are made of and no such value holds; issued
  keys within a value count for themselves,
- the word itself, of LEAST characters or more, if it gives nothing else.

A word of over LONG characters, such as a line of minified JSON, is cut before each sign
that another name follows, and its parts are looked at as words of the same number.

Each has features of

- its length, and shares of digits, upper-case letters and other signs,
- its character transitions: between letter and digit, between cases, from vowel to
  consonant, repeated characters, distinct characters,
- dictionary coverage: the share of it that pieces of common words cover,
- its path: signs of an address, a file path or a URL in the word it stands in, and
- the neighbouring words: whether a word before or after, or the name it is assigned to,
  speaks of keys, passwords or tokens, and whether quotes or a sign introduce it.

The forest learns from labelled findings. The corpus labels itself by rule (``labelled``):
formats that issuers fix, values assigned to a named credential and passwords of addresses are
true findings, whatever they look like; other addresses, paths, plain numbers, words with a
number at the end and words without digits and odd capitals are false ones; the rest has no
label, and so have links, placeholders and, after ``is``, values without a digit that are
assigned. A sample of FINDINGS of each rule, bounded, is learnt from. All candidates of all
texts are then scored.

Defined results: null and empty texts have no candidates and so no rows; null ids and
repeated rows give rows of their own; where one kind of labelled finding is missing nothing
can be learnt and the rules decide (score 1 or 0); other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comity.llm.common import stored, text_of

LEAST = 12
FINDINGS = 4_000
TREES = 20
DEPTH = 6
THRESHOLD = 0.5
LONGEST = 512  # a longer body is a secret by no rule; it is scored by its whole length

#: Formats of issued keys, names of credentials, pieces of common words.
ISSUED = (
    r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|"
    r"^sk_(live|test)_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$"
)
CREDENTIAL = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)"
HINT = r"(?i)key|secret|token|passw|pwd|auth|credential|bearer|aws"
PIECES = (
    r"tion|ment|ing|the|and|for|ers|able|ness|ally|est|com|net|org|www|http|mail|example|page|"
    r"index|html|image|user|file|data|this|that|with|from|ente|ung|lich|keit|sch|que|les|des|"
    r"par|los|las|ado|aci"
)
ADDRESS = r"(?i)@[a-z0-9-]+\.|^https?:|^www\.|^[/~.]|\.(com|org|net|html?)\b"
NUMBER = r"^[^\p{L}]+$|^\p{L}+[\d.,:]+[^\p{L}\d]*$"
#: Not an ordinary word or a compound of them.
MIXED = r"[0-9]|\p{Ll}\p{Lu}|\p{Lu}{2}\p{Ll}"
NOT_GIVEN = (
    r"(?i)^(https?|ftp)://|^www\.|^[$%<{]|^(null|none|nil|true|false|undefined)$|^[^\p{L}\p{N}]+$"
)

#: Parts of a word. MARK is put before a sign that another name follows.
MARK = "\u0001"
NEXT_NAME = r"(?=[,;&|][\\\"'\w.-]{1,64}[=:])"
NAMED = (
    r"(?i)(?:pass(?:word|wd|phrase)|pwd|secret|token|api[ _-]?key|access[ _-]?key|"
    r"private[ _-]?key|credential)(?:[_-]?[0-9]{1,3})?[\\\"'\]]{0,3}"
)
SIGN = r"(?:\s*(?::=|=>|={1,3}|:(?!//))\s*|\s+is\s+)"
NAME_BEFORE = NAMED + r"(?:\s+|" + SIGN + ")$"
IN_QUOTES = NAMED + SIGN + r"\\?[\"']((?<=\\[\"'])[^\"'\\]+|(?<=\")[^\"]+|(?<=')[^']+)"
OPEN_QUOTE = NAMED + SIGN + r"\\?[\"'][^\"']*$"
BARE = NAMED + SIGN + "([^\\s\"'<>\\\\=:,;&" + MARK + "][^\\s\"'<>" + MARK + "]*)"
CLOSING = r"[.,;:?)\]}>]+$"
USERINFO = r"://([^\s/?#:@]*):([^\s/?#\"'<>]+)@"
RUN = r"([A-Za-z0-9+/_-]{12,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?)"
QUOTED = 16  # words that are looked at first for a closing quote
LONG = 1024  # characters of a word that is looked at in parts

TRUE_RULES = ("issued", "userinfo", "assigned")
FALSE_RULES = ("address", "number", "word")

FEATURES = (
    "f_length f_digits f_upper f_signs f_letter_digit f_case f_vowels f_repeats f_distinct "
    "f_words f_address f_slashes f_dots f_before f_after f_name f_quoted"
).split()


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_no, word, before, after, body, how and lead of every candidate.

    ``how`` is assigned, said (after ``is``), userinfo, run or word.
    """
    words = docs.select("doc_id", F.split(text_of(docs), r"\s+").alias("_w"),
                        text_of(docs).rlike(NAMED).alias("_named"))
    # Parts of long words, each with its word's place; null where no word is long.
    words = words.withColumn("_parts", F.when(
        F.exists("_w", lambda w: F.length(w) > LONG),
        F.flatten(F.transform("_w", lambda w, i: F.transform(
            F.when(F.length(w) > LONG, F.split(w, NEXT_NAME)).otherwise(F.array(w)),
            lambda p: F.struct(i.alias("no"), p.alias("part")))))))
    words = words.select(
        "doc_id", "_named", F.col("_parts.no").alias("_no"),
        # Blanks at the start of a text make an empty word, which is none.
        F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0).alias("_empty"),
        F.coalesce("_parts.part", "_w").alias("_w"))

    def word(at: Column) -> Column:
        return F.coalesce(F.when(at >= 0, F.get("_w", at)), F.lit(""))

    picked = F.filter(
        F.sequence(F.lit(0), F.size("_w") - 1),
        lambda i: (F.length(word(i)) >= LEAST) | word(i).contains("://")
        | (F.col("_named") & F.concat_ws(" ", word(i - 2), word(i - 1), word(i)).rlike(NAMED)))

    quotes = "^[^\"']*[\"']"

    def to_closing(i: Column) -> Column:
        """The words after a quote that opens at the end of word i, to the closing one."""
        near = F.regexp_extract(F.array_join(F.slice("_w", i + 2, QUOTED - 1), " "), quotes, 0)
        opens = F.concat_ws(" ", word(i - 2), word(i - 1), word(i)).rlike(OPEN_QUOTE)
        far = F.regexp_extract(
            F.array_join(F.slice("_w", i + 2, F.size("_w")), " "), quotes, 0)
        return F.when((near != "") | ~opens, near).otherwise(far)

    def found(i: Column) -> Column:
        return F.struct(
            (F.coalesce(F.get("_no", i), i) - F.col("_empty")).cast("long").alias("word_no"),
            word(i).alias("word"),
            F.concat_ws(" ", word(i - 2), word(i - 1)).alias("before"),
            word(i + 1).alias("after"),
            F.when(F.col("_named") & word(i).rlike("[\"']"), to_closing(i)).alias("_rest"))

    rows = words.select("doc_id", F.explode(F.transform(picked, found)).alias("_f"))
    rows = rows.select("doc_id", "_f.*")
    # The name that the words before end with, and the word without passwords of addresses.
    rows = rows.withColumns({
        "_name": F.regexp_extract(F.concat("before", F.lit(" ")), NAME_BEFORE, 0),
        "_users": F.regexp_extract_all("word", F.lit(USERINFO), F.lit(2)),
        "_word": F.regexp_replace(
            F.regexp_replace("word", USERINFO, "://$1@"), NEXT_NAME, MARK),
    })
    rows = rows.withColumn("_all", F.concat("_name", "_word"))
    rows = rows.withColumn("_all", F.concat("_all", F.when(
        F.col("_rest").isNotNull() & F.col("_all").rlike(OPEN_QUOTE),
        F.concat(F.lit(" "), F.col("_rest"))).otherwise("")))
    link = F.col("word").contains("://")

    def bare(value: Column) -> Column:
        return F.regexp_replace(
            F.when(link, F.regexp_extract(value, "^[^#&]+", 0)).otherwise(value), CLOSING, "")

    quoted = F.transform(
        F.regexp_extract_all("_all", F.lit(IN_QUOTES)), lambda v: F.replace(v, F.lit(MARK)))
    plain = F.transform(F.regexp_extract_all("_all", F.lit(BARE)), bare)
    rows = rows.withColumns({
        "_values": F.filter(F.concat(quoted, plain), lambda v: v != ""),
        "_runs": F.regexp_extract_all(F.regexp_replace(
            "_word", r"[\w.-]{0,64}" + NAMED.replace("(?i)", "(?i:", 1) + ")" + SIGN, " "),
            F.lit(RUN)),
    })
    taken = F.concat("_values", "_users")
    runs = F.filter("_runs", lambda r: ~F.exists(
        taken, lambda v: (v == r) | (v.contains(r) & ~r.rlike(ISSUED))))

    def parts(bodies: Column, how: Column) -> Column:
        return F.transform(bodies, lambda v: F.struct(v.alias("body"), how.alias("how")))

    said = F.when(F.col("_name").rlike(r"(?i)\sis\s*$"), "said").otherwise("assigned")
    rows = rows.withColumn("_parts", F.concat(
        parts(F.col("_values"), said), parts(F.col("_users"), F.lit("userinfo")),
        parts(runs, F.lit("run"))))
    whole = F.when(F.length("word") >= LEAST, parts(F.array("word"), F.lit("word")))
    rows = rows.select(
        "doc_id", "word_no", "word", "before", "after",
        F.inline(F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(whole)))
    return rows.withColumn("lead", F.expr("substring_index(word, substring_index(body, ' ', 1), 1)"))


def with_features(rows: DataFrame) -> DataFrame:
    """The features of FEATURES; each is a share, a count or a flag."""
    body = F.col("body")
    length = F.greatest(F.length(body), F.lit(1))

    def count(pattern: str) -> Column:
        return F.regexp_count(body, F.lit(pattern)) / length

    return rows.withColumns({
        "f_length": F.log1p(F.length(body)),
        "f_digits": count("[0-9]"),
        "f_upper": count(r"\p{Lu}"),
        "f_signs": count(r"[^\p{L}0-9]"),
        "f_letter_digit": count(r"(?<=[0-9])(?=\p{L})|(?<=\p{L})(?=[0-9])"),
        "f_case": count(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Ll})"),
        "f_vowels": count(r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])"),
        "f_repeats": count(r"(?=(.)\1)"),
        "f_distinct": F.size(F.array_distinct(F.split(body, ""))) / length,
        "f_words": 1 - F.length(F.regexp_replace(F.lower(body), PIECES, "")) / length,
        "f_address": F.col("word").rlike(ADDRESS).cast("double"),
        "f_slashes": F.regexp_count("word", F.lit("/")).cast("double"),
        "f_dots": F.regexp_count("word", F.lit(r"\.")).cast("double"),
        "f_before": F.col("before").rlike(HINT).cast("double"),
        "f_after": F.col("after").rlike(HINT).cast("double"),
        "f_name": (F.col("lead").rlike(HINT) | (F.col("how") == "userinfo")).cast("double"),
        "f_quoted": F.col("lead").rlike("[\"'=:]").cast("double"),
    })


def labelled(rows: DataFrame) -> DataFrame:
    """``rule`` of each candidate, and ``label``: 1 true, 0 false, null unknown."""
    body, how = F.col("body"), F.col("how")
    named = F.concat_ws(" ", "before", "lead")
    assigned = how.isin("assigned", "said") | named.rlike(
        CREDENTIAL + r"[\"']?\s*(=|:|:=|is)\s*[\"']?$")
    unsure = body.rlike(NOT_GIVEN) | (F.length("body") > LONGEST) | (
        (how == "said") & ~body.rlike("[0-9]"))
    rule = (
        F.when(body.rlike(ISSUED), "issued")
        .when(how == "userinfo", "userinfo")
        .when(assigned & ~unsure, "assigned")
        .when(assigned, "unknown")
        .when(F.col("word").rlike(ADDRESS), "address")
        .when(F.col("word").rlike(NUMBER) | body.rlike("^[0-9]+$"), "number")
        .when(~body.rlike(MIXED), "word")
        .otherwise("unknown")
    )
    label = F.when(F.col("rule").isin(*TRUE_RULES), 1.0).when(
        F.col("rule").isin(*FALSE_RULES), 0.0)
    return rows.withColumn("rule", rule).withColumn("label", label)


def train(rows: DataFrame):
    """A forest fitted on a bounded sample of labelled findings; None with one kind only."""
    order = F.xxhash64(F.lit("secret"), "body", "word_no")
    kinds = [
        rows.filter(F.col("rule") == rule).orderBy(order, "doc_id").limit(FINDINGS)
        .select("label", *FEATURES) for rule in TRUE_RULES + FALSE_RULES
    ]
    sample = stored(reduce(DataFrame.unionByName, kinds), "secret-findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=3)
    return forest.fit(assembled(sample))


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, word_no, length, rule, score, is_secret and secret_sha256 of each candidate.

    ``word_no`` counts the text's words between white space from 0. The secret itself is not
    given out.
    """
    rows = stored(
        labelled(with_features(candidates(docs))).select(
            "doc_id", "word_no", "body", "rule", "label", *FEATURES),
        "secret-candidates")
    model = train(rows)
    if model is None:
        scored = rows.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(assembled(rows)).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "word_no", F.length("body").cast("long").alias("length"), "rule", "score",
        (F.col("score") >= THRESHOLD).alias("is_secret"),
        F.sha2("body", 256).alias("secret_sha256"))
