"""Labels, thresholds and word lists that results depend on."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Labels and thresholds.
# ---------------------------------------------------------------------------

LABELS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")

HATE_LABELS = ("identity_hate", "threat", "severe_toxic")
OFFENSIVE_LABELS = ("toxic", "insult", "obscene")

TRAINING_LABELS = ("toxicity", "insult", "threat", "identity_attack")

LABEL_THRESHOLD = 0.5
HATE_THRESHOLD = 0.30
OFFENSIVE_THRESHOLD = 0.50
EXCLUSION_RULE_SCORE = 0.95
REFINED_CONFIDENCE_FLOOR = 0.50
MAX_PREDICTION_CHARS = 10_000

CLASSES = (0, 1, 2)
CLASS_NAMES = {0: "Hate Speech", 1: "Offensive Language", 2: "Neither"}
CLASS_IDS = {0: "01", 1: "02", 2: "03"}

LABEL_ALIASES = {
    "identity-hate": "identity_hate",
    "identity hate": "identity_hate",
    "severe-toxic": "severe_toxic",
    "severe toxic": "severe_toxic",
}

FAILED = "Error"
UNSAVED_PREDICTIONS = ("Error", "Model Unavailable")

# ---------------------------------------------------------------------------
# Column names accepted in loosely structured inputs.
# ---------------------------------------------------------------------------

TEXT_COLUMNS = ("text", "comment_text", "comment", "Text", "Comment", "commentText")
PREDICTION_COLUMNS = (
    "prediction", "predicted", "label", "toxicity", "result", "classification",
)
CATEGORY_COLUMNS = {
    "toxic": ("toxic", "toxicity"),
    "obscene": ("obscene", "obscenity"),
    "insult": ("insult",),
    "threat": ("threat",),
    "identity_hate": ("identity_hate", "identity hate", "identityhate"),
    "severe_toxic": ("severe_toxic", "severe toxic", "severetoxic"),
}
POSITIVE_WORDS = (
    "toxic", "yes", "true", "1", "positive", "hate", "insult", "obscene", "threat",
)

# ---------------------------------------------------------------------------
# The linguistic rules, as plain words and phrases. A blank in a
# phrase stands for any run of white space.
# ---------------------------------------------------------------------------

IDENTITY_WORDS = (
    "race", "racial", "racist", "racism", "ethnicity", "ethnic", "religion",
    "religious", "nationality", "national", "immigrant", "immigrants", "gender",
    "sexuality", "disability", "disabled",
)
HATE_VERBS = (
    "hate", "hates", "hated", "despise", "despises", "despised", "attack",
    "attacking", "target", "targeting",
)
THREAT_PHRASES = (
    "i will hurt you", "i'll hurt you", "i am going to hurt you", "i'm going to hurt you",
    "i will kill you", "i'll kill you", "i am going to kill you", "i'm going to kill you",
    "you will be hurt", "you are going to die", "you're going to die",
)
INSULT_ADJECTIVES = ("stupid", "pathetic", "terrible", "disgusting", "useless", "awful")
INSULT_NOUNS = ("idiot", "moron", "asshole", "jerk")
DIRECT_HATE_VERBS = ("hate", "despise")
DIRECT_HATE_TARGETS = ("you", "him", "her", "them")
OFFENSIVE_PHRASES = (
    "disgusting", "shut up", "idiot", "idiots", "moron", "morons", "stupid", "pathetic",
    "jerk", "awful", "useless", "terrible", "asshole",
)
GROUP_PHRASES = (
    "ethnic group", "ethnic groups", "race", "racial group", "racial groups",
    "nationality", "nationalities", "religious group", "religious groups", "religion",
    "immigrant", "immigrants", "minority group", "minority groups",
    "people from that group",
)
EXCLUSION_PHRASES = (
    "should not be allowed", "must not be allowed", "shouldn't be allowed",
    "mustn't be allowed", "should be banned", "must be banned", "should be removed",
    "must be removed", "should be excluded", "must be excluded", "not allowed to live",
    "not allowed to stay", "not allowed to enter", "not allowed to join",
    "should not live", "shouldn't live", "should leave our community",
    "must leave our community", "keep them out", "keep that group out",
    "keep those people out", "exclude them", "exclude that group",
)

RULE_IDENTITY = "Identity-targeting linguistic rule"
RULE_THREAT = "Threat linguistic rule"
RULE_INSULT = "Personal-insult linguistic rule"
RULE_DIRECT_HATE = "Direct-hate linguistic rule"
RULE_OFFENSIVE = "Offensive-language linguistic rule"

# ---------------------------------------------------------------------------
# The built-in lexicon: token weights per label and one bias per label. All are
# multiples of 0.25, so sums are exact in any order of addition.
# ---------------------------------------------------------------------------

LEXICON = {
    "toxic": {
        "idiot": 2.5, "idiots": 2.5, "moron": 2.5, "morons": 2.5, "stupid": 2.0,
        "pathetic": 2.0, "disgusting": 2.0, "jerk": 2.0, "asshole": 3.0, "awful": 1.0,
        "useless": 1.5, "terrible": 1.0, "hate": 1.5, "trash": 1.5, "scum": 2.0,
        "loser": 1.75, "clown": 1.25, "worthless": 1.75, "kill": 1.5,
    },
    "severe_toxic": {
        "asshole": 1.5, "scum": 2.0, "kill": 1.75, "worthless": 1.25, "disgusting": 1.0,
    },
    "obscene": {"asshole": 3.5, "scum": 1.25, "trash": 1.0, "disgusting": 1.5},
    "threat": {"kill": 3.0, "hurt": 2.25, "die": 2.0, "attack": 2.0, "threat": 1.0},
    "insult": {
        "idiot": 3.0, "idiots": 3.0, "moron": 3.0, "morons": 3.0, "stupid": 2.25,
        "pathetic": 1.75, "jerk": 2.25, "asshole": 2.0, "useless": 1.5, "loser": 2.0,
        "clown": 1.5, "worthless": 1.5, "scum": 1.0,
    },
    "identity_hate": {
        "racist": 1.0, "immigrants": 1.25, "hate": 1.75, "despise": 1.75, "scum": 1.5,
    },
}
LEXICON_BIAS = {
    "toxic": -2.0, "severe_toxic": -3.5, "obscene": -3.0, "threat": -3.25,
    "insult": -2.5, "identity_hate": -3.0,
}
NEITHER_LOGIT = 1.5
