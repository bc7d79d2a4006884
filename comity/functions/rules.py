"""Linguistic rules over word lists and phrases.

Every rule needs one of a few marker words. The words of a text are split out once
(``rule_words``); the phrase patterns then run only on the texts that hold a marker,
and the pure word rules need no pattern at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from comity import constants as K
from comity.functions.text import SPACE, WORD, or_empty, rule_text, words_in

THREAT_MARKERS = ("hurt", "kill", "die")
INSULT_MARKERS = K.INSULT_ADJECTIVES + K.INSULT_NOUNS
OFFENSIVE_WORDS = tuple(p for p in K.OFFENSIVE_PHRASES if " " not in p)
OFFENSIVE_PAIRS = tuple(p for p in K.OFFENSIVE_PHRASES if " " in p)

RULE_VOCABULARY = frozenset(
    K.IDENTITY_WORDS + K.HATE_VERBS + THREAT_MARKERS + INSULT_MARKERS
    + K.DIRECT_HATE_VERBS + OFFENSIVE_WORDS + ("shut",)
)


def bounded(alternatives: str) -> str:
    """Whole-word match with Unicode word boundaries."""
    return rf"(?U)(?<!{WORD})(?:{alternatives})(?!{WORD})"


def phrase(text: str) -> str:
    return f"{SPACE}+".join(re.escape(part) for part in text.split(" "))


def any_phrase(phrases) -> str:
    return bounded("|".join(phrase(p) for p in phrases))


def _insult_pattern() -> str:
    nouns = "|".join(K.INSULT_NOUNS)
    adjectives = "|".join(K.INSULT_ADJECTIVES)
    plain = rf"(?:you{SPACE}+are|you're){SPACE}+(?:{adjectives}|an?{SPACE}+(?:{nouns}))"
    doubled = (
        rf"you{SPACE}+(?:you're|'re){SPACE}+(?:stupid|an?{SPACE}+(?:idiot|moron))"
    )
    return bounded(f"{plain}|{doubled}")


def _direct_hate_pattern() -> str:
    verbs, targets = "|".join(K.DIRECT_HATE_VERBS), "|".join(K.DIRECT_HATE_TARGETS)
    return bounded(rf"i{SPACE}+(?:{verbs}){SPACE}+(?:{targets})")


THREAT = any_phrase(K.THREAT_PHRASES)
INSULT = _insult_pattern()
DIRECT_HATE = _direct_hate_pattern()
OFFENSIVE_PAIR = any_phrase(OFFENSIVE_PAIRS)
GROUP = any_phrase(K.GROUP_PHRASES)
EXCLUSION = any_phrase(K.EXCLUSION_PHRASES)


def rule_words(text: Column | str) -> Column:
    return words_in(text, RULE_VOCABULARY)


def has_any(words: Column, vocabulary) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary]))


def _parts(text: Column | str, words: Column | None) -> tuple[Column, Column]:
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(text), rule_words(text) if words is None else words


def explicit_threat(text: Column | str, words: Column | None = None) -> Column:
    lowered, words = _parts(text, words)
    return has_any(words, THREAT_MARKERS) & lowered.rlike(THREAT)


def identity_targeting(text: Column | str, words: Column | None = None) -> Column:
    _, words = _parts(text, words)
    return has_any(words, K.IDENTITY_WORDS) & has_any(words, K.HATE_VERBS)


def personal_insult(text: Column | str, words: Column | None = None) -> Column:
    lowered, words = _parts(text, words)
    return has_any(words, INSULT_MARKERS) & lowered.rlike(INSULT)


def direct_hate(text: Column | str, words: Column | None = None) -> Column:
    lowered, words = _parts(text, words)
    return has_any(words, K.DIRECT_HATE_VERBS) & lowered.rlike(DIRECT_HATE)


def common_offensive(text: Column | str, words: Column | None = None) -> Column:
    lowered, words = _parts(text, words)
    return has_any(words, OFFENSIVE_WORDS) | (
        has_any(words, ("shut",)) & lowered.rlike(OFFENSIVE_PAIR)
    )


def first_rule(text: Column | str, words: Column | None = None) -> Column:
    """Name of the first rule that fires, null when none does."""
    return (
        F.when(identity_targeting(text, words), F.lit(K.RULE_IDENTITY))
        .when(explicit_threat(text, words), F.lit(K.RULE_THREAT))
        .when(personal_insult(text, words), F.lit(K.RULE_INSULT))
        .when(direct_hate(text, words), F.lit(K.RULE_DIRECT_HATE))
        .when(common_offensive(text, words), F.lit(K.RULE_OFFENSIVE))
    )


# One of these occurs in every exclusion phrase.
EXCLUSION_MARKERS = (
    "allowed", "banned", "removed", "excluded", "live", "leave", "keep", "exclude",
)


def group_exclusion(text: Column | str) -> Column:
    """A group reference together with a call to exclude it, on the reduced text.

    Reducing a text never joins letters, so one without a marker cannot match and is
    spared the reduction.
    """
    text = F.col(text) if isinstance(text, str) else text
    def marked(lowered: Column) -> Column:
        found = F.lit(False)
        for marker in EXCLUSION_MARKERS:
            found = found | lowered.contains(marker)
        return found

    def matches(reduced: Column) -> Column:
        return reduced.rlike(EXCLUSION) & reduced.rlike(GROUP)

    # exists() over one element binds its value, so that is computed once. when() rather
    # than "&": the common parts of a conjunction are computed ahead of its first test.
    candidate = F.exists(F.array(F.lower(or_empty(text))), marked)
    return F.when(candidate, F.exists(F.array(rule_text(text)), matches)).otherwise(False)
