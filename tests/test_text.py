from pyspark.sql import functions as F

from comity.functions import text as tx


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


CASES = [
    ("https://t.co/abc", ""),
    ("see HTTP://X.y/z?q=1 now", "see now"),
    ("Www.Site.com/x end", "end"),
    ("RT @a: hi", "hi"),
    ("RT @a hi there", "hi there"),
    ("RT : @a hi", "hi"),
    ("RT hello world", "world"),
    ("rtx card", "card"),
    ("part of art", "part of art"),
    ("vért RT", "vért"),
    ("@josé hola", "hola"),
    ("mail me@x.com", "mail me .com"),
    ("a&amp;amp;b", "a&b"),
    ("&lt;b&gt; &#128514; &eacute;", "<b> 😂 é"),
    ("one\\ntwo\\tthree", "one two three"),
    (" tab\tand\nline nbsp em\x1cfs ", "tab and line nbsp em fs"),
    ("   ", ""),
    (None, ""),
    ("RT RT RT x", ""),
]


def test_clean_tweet_hand_computed(spark):
    expected = [want for _, want in CASES]
    assert apply(spark, tx.clean_tweet, [text for text, _ in CASES]) == expected


def test_core_entities_match_full_decoding(spark):
    texts = ["a &amp;lt; b", "&quot;x&quot; &#39;y&#39;", "plain & simple", None]
    assert apply(spark, lambda c: tx.clean_tweet(c, "core"), texts) == apply(
        spark, tx.clean_tweet, texts
    )


def test_strict_retweets_keep_words(spark):
    texts = ["RT hello world", "rtx card", "RT @a: hi", "so RT: hi"]
    assert apply(spark, lambda c: tx.clean_tweet(c, strict_retweets=True), texts) == [
        "hello world", "rtx card", "hi", "so hi",
    ]


def test_clean_is_idempotent(spark):
    texts = ["see http://a.b  now", "@x y", "  two   words ", "line\nbreak"]
    once = apply(spark, tx.clean_tweet, texts)
    assert apply(spark, tx.clean_tweet, once) == once


def test_blank_tests_agree_with_cleaning(spark):
    texts = [None, "", " \n\t", " \x1c", "x", " @a", "@a @b http://c", "www.x", "h",
             "@awww.x", "@ a", "http:// a"]
    blank = apply(spark, tx.is_blank, texts)
    assert blank == [t == "" for t in apply(spark, tx.clean_text, texts)]
    normalized = apply(spark, tx.normalize_text, texts)
    assert apply(spark, tx.is_blank_normalized, texts) == [t == "" for t in normalized]


def test_rule_text(spark):
    assert apply(spark, tx.rule_text, ["They SHOULDN'T, be: self-made! é9"]) == [
        "they shouldn't be self-made 9"
    ]


def test_preview_language_and_names(spark):
    long = "x" * 61
    assert apply(spark, lambda c: tx.preview(c, 60), [long, "x" * 60, None]) == [
        "x" * 60 + "...", "x" * 60, None,
    ]
    assert apply(spark, lambda c: tx.resolve_language(c, F.lit("fr")),
                 ["un deux trois", "un deux trois quatre", "", None]) == ["en", "fr", "en", "en"]
    assert apply(spark, lambda c: tx.resolve_language(c, F.lit(None).cast("string")),
                 ["a b c d e"]) == ["en"]
    assert apply(spark, tx.display_label, ["severe_toxic"]) == ["Severe Toxic"]
    assert apply(spark, tx.iso_date_prefix, ["2024-01-02T03:04:05Z"]) == ["2024-01-02"]


def test_words_in_keeps_repeats_and_whole_words(spark):
    got = apply(spark, lambda c: tx.words_in(c, {"idiot"}), ["Idiot, éidiot IDIOT idiots"])
    assert got == [["idiot", "idiot"]]
