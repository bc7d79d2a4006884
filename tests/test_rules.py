import pytest
from pyspark.sql import functions as F

from comity import constants as K
from comity.functions import rules, video
from comity.operators import verdicts

SENTENCES = [
    ("You are stupid", K.RULE_INSULT, 1),
    ("You are an idiot", K.RULE_INSULT, 1),
    ("I will hurt you", K.RULE_THREAT, 1),
    ("I'll  kill\nyou", K.RULE_THREAT, 1),
    ("I am going to hurt you", K.RULE_THREAT, 1),
    ("You're going to die", K.RULE_THREAT, 1),
    ("I hate this person because of their race", K.RULE_IDENTITY, 0),
    ("I hate you", K.RULE_DIRECT_HATE, 1),
    ("I despise them", K.RULE_DIRECT_HATE, 1),
    ("This is disgusting", K.RULE_OFFENSIVE, 1),
    ("You are a terrible person", K.RULE_OFFENSIVE, 1),
    ("You are such an idiot.", K.RULE_OFFENSIVE, 1),
    ("please shut   up", K.RULE_OFFENSIVE, 1),
    ("you you're stupid", K.RULE_INSULT, 1),
    ("you 're an idiot", K.RULE_INSULT, 1),
    ("I love everyone", None, None),
    ("Have a wonderful day", None, None),
    ("Stop being so annoying.", None, None),
    ("People of that ethnicity should not be allowed here.", None, None),
    ("éidiot and idiotic", None, None),
    ("they hate racing", None, None),
    ("shut the door", None, None),
]


@pytest.fixture(scope="module")
def sentences(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(SENTENCES)]
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_first_rule(sentences):
    got = sentences.orderBy("doc_id").select(rules.first_rule("text")).collect()
    assert [r[0] for r in got] == [rule for _, rule, _ in SENTENCES]


def test_rule_classes_and_refinement(sentences):
    rows = verdicts.classify_tweets(sentences).orderBy("doc_id").collect()
    for row, (_, rule, cls) in zip(rows, SENTENCES):
        assert row["final_class"] == (row["model_class"] if cls is None else cls)
        assert row["refinement_applied"] == (row["final_class"] != row["model_class"])
        assert row["classification_method"] == (rule or "Classifier model")
        assert row["toxicity"] == ("Toxic" if row["final_class"] < 2 else "Non-Toxic")
        if row["refinement_applied"]:
            assert row["confidence"] >= 0.5
        else:
            assert row["confidence"] == row["model_confidence"]


def test_texts_without_content_get_no_class(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "@a http://b"), (4, "ok")],
                               "doc_id int, text string")
    assert [r["doc_id"] for r in verdicts.classify_tweets(df).collect()] == [4]


def test_group_exclusion(spark):
    texts = [
        ("people from that group should be banned", True),
        ("IMMIGRANTS must not -- be, allowed", False),
        ("Immigrants must not be allowed!", True),
        ("religious   groups: keep them out", True),
        ("people of that ethnicity should not be allowed here", False),
        ("keep them out", False),
        ("the race was great", False),
        (None, False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(rules.group_exclusion("t")).collect()
    assert [r[0] for r in got] == [want for _, want in texts]


def test_every_phrase_holds_its_marker():
    for phrase in K.EXCLUSION_PHRASES:
        assert any(m in phrase for m in rules.EXCLUSION_MARKERS)
    for phrase in K.THREAT_PHRASES:
        assert any(m in phrase.split() for m in rules.THREAT_MARKERS)


VID = "abc_DEF-123"
LINKS = [
    # link, strict, by host, any host
    (f" {VID}\n", VID, VID, None),
    (f"https://www.youtube.com/watch?v={VID}&t=1", VID, VID, VID),
    (f"https://www.youtube.com/watch?t=1&v={VID}", None, VID, VID),
    ("https://www.youtube.com/watch?v=short", None, "short", None),
    ("https://www.youtube.com/watch?v=a%20b", None, "a b", None),
    (f"https://youtu.be/{VID}?si=x", VID, VID, VID),
    (f"https://youtu.be/{VID}/more", VID, VID, VID),
    (f"https://youtube.com/shorts/{VID}", VID, VID, VID),
    (f"https://www.youtube-nocookie.com/embed/{VID}", None, VID, VID),
    (f"https://user:pw@YouTube.com:443/embed/{VID}", None, VID, VID),
    (f"https://example.com/watch?v={VID}", None, None, VID),
    (f"https://example.com/youtube.com/watch?v={VID}", VID, None, VID),
    (f"youtube.com/watch?v={VID}", VID, None, VID),
    ("https://example.com/", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
]


def test_video_ids(spark):
    df = spark.createDataFrame([(i, l[0]) for i, l in enumerate(LINKS)], "i int, l string")
    rows = df.orderBy("i").select(
        video.video_id_strict("l"), video.video_id_by_host("l"), video.video_id_any_host("l")
    ).collect()
    assert [tuple(r) for r in rows] == [l[1:] for l in LINKS]
