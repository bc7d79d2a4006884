"""The same queries in DuckDB SQL, written independently of the operators.

Patterns use explicit Unicode classes and consuming word boundaries, because this
engine's own classes are ASCII-only and it has no look-behind.
"""

from __future__ import annotations

from comity import constants as K
from comity.plans.inputs import AS_OF, FACTORS, ODD_NAMES, PHRASES

SPACES = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
S, NS, W = f"[{SPACES}]", f"[^{SPACES}]", r"[\p{L}\p{N}_]"
OPEN, CLOSE = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({sub(x, S + '+')}, ' ')"


def strip(x: str) -> str:
    return sub(x, rf"^{S}+|{S}+$", "")


def urls(x: str) -> str:
    return sub(x, rf"(?i)https?://{NS}+|www\.{NS}+")


def mentions(x: str) -> str:
    return sub(x, f"@{W}+")


def retweets(x: str) -> str:
    """Shield a marker that follows a word character, then the ASCII boundary is right."""
    shielded = sub(x, rf"({W})([rR][tT])", r"\1zqzq\2")
    cut = sub(shielded, rf"(?i)\brt{S}*:?{S}*@?{W}*{S}*:?{S}*")
    return f"replace({cut}, 'zqzq', '')"


def decode_core(x: str) -> str:
    for _ in range(2):
        for entity, char in (
            ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
        ):
            x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def escapes(x: str) -> str:
    for sequence in ("\\n", "\\r", "\\t"):
        x = f"replace({x}, {q(sequence)}, ' ')"
    return x


def clean_tweet(x: str) -> str:
    return collapse(escapes(mentions(retweets(urls(decode_core(x))))))


def normalize(x: str) -> str:
    return collapse(mentions(urls(x)))


def reduce_text(x: str) -> str:
    return collapse(sub(f"lower({x})", rf"[^a-zA-Z0-9{SPACES}'-]"))


def alternation(phrases) -> str:
    return "|".join(p.replace(" ", f"{S}+") for p in phrases)


def found(x: str, alternatives: str) -> str:
    return f"regexp_matches(lower({x}), {q(OPEN + '(' + alternatives + ')' + CLOSE)})"


def pct(part: str, whole: str, digits: int) -> str:
    return (
        f"CASE WHEN {whole} = 0 THEN 0.0 ELSE "
        f"round_even({part}::DOUBLE / {whole} * 100, {digits}) END"
    )


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def cases(subject: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items())
    return f"CASE {subject} {whens} ELSE {q(default)} END"


PHRASED = (
    "phrased AS (SELECT doc_id, lang, source, "
    f"{cases('source', PHRASES, '')} || ' ' || text AS text FROM documents)"
)
TRUTH = "CASE WHEN toxic = 1 AND quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END"
LEXICON = ", ".join(
    f"({q(token)}, {q(label)}, {weight})"
    for label, table in K.LEXICON.items() for token, weight in table.items()
)
R5 = K.OFFENSIVE_PHRASES
RULES = {
    "identity": lambda x: (
        f"({found(x, alternation(K.IDENTITY_WORDS))} AND {found(x, alternation(K.HATE_VERBS))})"
    ),
    "threat": lambda x: found(x, alternation(K.THREAT_PHRASES)),
    "insult": lambda x: found(
        x,
        rf"(you{S}+are|you're){S}+({'|'.join(K.INSULT_ADJECTIVES)}"
        rf"|an?{S}+({'|'.join(K.INSULT_NOUNS)}))"
        rf"|you{S}+(you're|'re){S}+(stupid|an?{S}+(idiot|moron))",
    ),
    "direct_hate": lambda x: found(
        x, rf"i{S}+(hate|despise){S}+(you|him|her|them)"
    ),
    "offensive": lambda x: found(x, alternation(R5)),
}
RULE_NAMES = {
    "identity": K.RULE_IDENTITY, "threat": K.RULE_THREAT, "insult": K.RULE_INSULT,
    "direct_hate": K.RULE_DIRECT_HATE, "offensive": K.RULE_OFFENSIVE,
}


def first_rule(flags: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {flags[r]} THEN {q(RULE_NAMES[r])}" for r in RULES)
    return f"CASE {whens} ELSE {q(default)} END"


def sums(source: str, key: str = "doc_id", text: str = "text") -> str:
    """Weight sums per label: lex_sums(key, toxic, ...)."""
    cols = ", ".join(
        f"coalesce(sum(w) FILTER (WHERE label = {q(label)}), 0)::DOUBLE AS {label}"
        for label in K.LABELS
    )
    return (
        f"tokens AS (SELECT {key}, unnest(string_split_regex(lower({text}), "
        f"'[^\\p{{L}}\\p{{N}}_]+')) AS tok FROM {source}), "
        f"lexicon(tok, label, w) AS (VALUES {LEXICON}), "
        f"lex_sums AS (SELECT {key}, {cols} FROM {source} "
        f"LEFT JOIN tokens USING ({key}) LEFT JOIN lexicon USING (tok) GROUP BY {key})"
    )


def raw_score(label: str) -> str:
    return f"(1.0 / (1.0 + exp(-({label} + ({K.LEXICON_BIAS[label]})))))"


def scores(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    raw = ", ".join(f"{raw_score(label)} AS {label}_raw" for label in K.LABELS)
    blank = f"{strip('coalesce(' + text + ', ' + q('') + ')')} = ''"
    final = ", ".join(
        f"CASE WHEN blank THEN 0.0 ELSE round_even({label}_raw, 4) END AS {label}_score, "
        f"CASE WHEN NOT blank AND {label}_raw >= 0.5 THEN 1 ELSE 0 END AS {label}_flagged"
        for label in K.LABELS
    )
    return (
        f"{sums(source, key, text)}, "
        f"raws AS (SELECT {key}, {raw} FROM lex_sums), "
        f"scored AS (SELECT s.*, {final}, blank, "
        f"{', '.join(f'{label}_raw' for label in K.LABELS)} "
        f"FROM (SELECT *, {blank} AS blank FROM {source}) s JOIN raws USING ({key}))"
    )


SCORE_LIST = ", ".join(f"{label}_score" for label in K.LABELS)
FLAG_LIST = ", ".join(f"{label}_flagged" for label in K.LABELS)
TOP = f"greatest({SCORE_LIST})"
JUDGED = (
    f"judged AS (SELECT *, CASE WHEN {TOP} >= 0.5 THEN 'Toxic' ELSE 'Non-Toxic' END AS "
    f"prediction, CASE WHEN blank THEN 0.0 WHEN {TOP} >= 0.5 THEN round_even({TOP}, 4) "
    f"ELSE round_even(1.0 - {TOP}, 4) END AS confidence FROM scored)"
)
CLEANED = f"cleaned AS (SELECT * REPLACE ({collapse('text')} AS text) FROM documents)"
USABLE = f"{CLEANED}, usable AS (SELECT * FROM cleaned WHERE text <> '')"

HATE = "greatest(identity_hate_score, threat_score, severe_toxic_score)"
OFFENSIVE = "greatest(toxic_score, insult_score, obscene_score)"


def priority(identity: str = "identity_hate_score") -> str:
    hate = f"greatest({identity}, threat_score, severe_toxic_score)"
    ladder = [
        (f"{identity} >= 0.30", "identity_hate", identity),
        ("threat_score >= 0.30", "threat", "threat_score"),
        ("severe_toxic_score >= 0.30", "severe_toxic", "severe_toxic_score"),
    ]
    category = "CASE " + " ".join(f"WHEN {c} THEN {q(n)}" for c, n, _ in ladder) + " END"
    confidence = (
        "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, _, v in ladder)
        + f" WHEN {OFFENSIVE} >= 0.5 THEN {OFFENSIVE} ELSE 1.0 - {TOP} END"
    )
    return (
        f"ranked AS (SELECT *, {category} AS category0, "
        f"round_even({confidence}, 4) AS confidence, "
        f"round_even({identity}, 4) AS identity_score, "
        f"round_even({hate}, 4) AS hate_speech_score, "
        f"round_even({OFFENSIVE}, 4) AS offensive_score FROM scored), "
        "prioritised AS (SELECT *, CASE WHEN category0 IS NOT NULL THEN 'Hate Speech' "
        "WHEN offensive_score >= 0.5 THEN 'Toxic' ELSE 'Non-Toxic' END AS prediction, "
        "coalesce(category0, 'none') AS hate_category FROM ranked)"
    )


def tweets(source: str) -> str:
    """classified: the rule-refined tweet classification of a table with doc_id, text."""
    hate = " + ".join(K.HATE_LABELS)
    offensive = " + ".join(K.OFFENSIVE_LABELS)
    flags = ", ".join(f"{rule('cleaned')} AS r_{name}" for name, rule in RULES.items())
    chosen = first_rule({r: f"r_{r}" for r in RULES}, "Classifier model")
    return (
        f"norm AS (SELECT * FROM (SELECT *, {normalize('text')} AS cleaned FROM {source}) "
        f"WHERE cleaned <> ''), {sums('norm', 'doc_id', 'cleaned')}, "
        f"logits AS (SELECT doc_id, {hate} AS lh, {offensive} AS lo, "
        f"{K.NEITHER_LOGIT}::DOUBLE AS ln FROM lex_sums), "
        "expd AS (SELECT doc_id, exp(lh - greatest(lh, lo, ln)) AS eh, "
        "exp(lo - greatest(lh, lo, ln)) AS eo, exp(ln - greatest(lh, lo, ln)) AS en "
        "FROM logits), "
        "probs AS (SELECT doc_id, eh / (eh + eo + en) AS ph, eo / (eh + eo + en) AS po, "
        "en / (eh + eo + en) AS pn FROM expd), "
        f"ruled AS (SELECT *, {chosen} AS method, "
        "CASE WHEN ph >= po AND ph >= pn THEN 0 WHEN po >= pn THEN 1 ELSE 2 END AS "
        f"model_class FROM (SELECT norm.*, ph, po, pn, {flags} FROM norm JOIN probs "
        "USING (doc_id))), "
        f"finals AS (SELECT *, CASE WHEN method = {q(K.RULE_IDENTITY)} THEN 0 WHEN method "
        "<> 'Classifier model' THEN 1 ELSE model_class END AS final_class FROM ruled), "
        "picked AS (SELECT *, CASE model_class WHEN 0 THEN ph WHEN 1 THEN po ELSE pn END "
        "AS pm, CASE final_class WHEN 0 THEN ph WHEN 1 THEN po ELSE pn END AS pf "
        "FROM finals), "
        "classified AS (SELECT *, final_class <> model_class AS refined, CASE WHEN "
        "final_class <> model_class THEN greatest(pf, 0.5) ELSE pm END AS conf FROM picked)"
    )


NAME_OF = (
    "CASE {c} WHEN 0 THEN 'Hate Speech' WHEN 1 THEN 'Offensive Language' "
    "ELSE 'Neither' END"
)

# --- history ----------------------------------------------------------------

KVAL = "json_extract_string(props, '$.k')::INTEGER"


def _label_json(names, extra="") -> str:
    parts = []
    for label, factor in FACTORS.items():
        lead = ", " if parts else "{"
        parts.append(q(f'{lead}"{names.get(label, label)}": 0.'))
        parts.append(f"lpad((k * {factor} % 100)::VARCHAR, 2, '0')")
    return " || ".join(parts) + " || " + q(extra + "}")


HISTORY = f"""history AS (SELECT event_id AS id, user_id,
 concat_ws(' ', 'A comment on', event_type, 'with properties', props,
   CASE WHEN k > 60 THEN 'and a longer tail' END) AS input_text,
 CASE WHEN k < 90 THEN 'en' END AS language,
 CASE WHEN value < 2 THEN 'Toxic' WHEN value < 4 THEN 'toxic' WHEN value < 8 THEN 'Non-Toxic'
   WHEN value < 10 THEN 'non toxic' WHEN value < 14 THEN 'Hate Speech'
   WHEN value < 16 THEN 'Offensive Language' WHEN value < 18 THEN 'Neither'
   WHEN value < 19 THEN 'Error' WHEN value < 20 THEN 'Model Unavailable'
   ELSE 'Non-Toxic' END AS prediction,
 k / 100.0::DOUBLE AS confidence,
 CASE event_type WHEN 'view' THEN {_label_json({})}
   WHEN 'click' THEN {_label_json(ODD_NAMES)}
   WHEN 'purchase' THEN {_label_json({}, ', "hate_category": "threat"')}
   WHEN 'signup' THEN '{{"toxic": 0.' || lpad(k::VARCHAR, 2, '0') || ', "insult": "0.' ||
     lpad((k * 41 % 100)::VARCHAR, 2, '0') || '"}}'
   ELSE CASE WHEN k < 50 THEN '{{"toxic": 0.9' END END AS labels_json,
 CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'csv' WHEN 'purchase' THEN 'api'
   WHEN 'signup' THEN ' Twitter ' ELSE '' END AS source,
 ts AS created_at
 FROM (SELECT *, {KVAL} AS k FROM events)),
parsed AS (SELECT *, CASE WHEN labels_json IS NOT NULL AND json_valid(labels_json)
  THEN labels_json ELSE '{{}}' END AS labels FROM history)"""

TITLED = f"""analyses AS (SELECT event_id AS id, user_id,
 CASE WHEN event_type = 'view' THEN 'YouTube' ELSE 'Text' END AS analysis_type,
 CASE WHEN value < 5 THEN 'Toxic' ELSE 'Non-Toxic' END AS prediction, k, event_type
 FROM (SELECT *, {KVAL} AS k FROM events))"""


def jget(label: str, column: str = "labels") -> str:
    path = q(f'$."{label}"')
    return f"TRY_CAST(json_extract_string({column}, {path}) AS DOUBLE)"


STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
TOXIC, NON_TOXIC = "lower(prediction) = 'toxic'", "lower(prediction) IN ('non-toxic', 'non toxic')"
SRC = "lower(trim(coalesce(source, '')))"

# --- comments ---------------------------------------------------------------

_PHRASE_BY_TURN = cases(
    "turn::VARCHAR", {str(i): p for i, p in enumerate(PHRASES.values())}, ""
)
COMMENTS = (
    "raw_comments AS (SELECT conv_id AS user_id, conv_id::VARCHAR AS video_id, turn AS "
    "position, conv_id || '-' || turn AS comment_id, role AS author, "
    f"{collapse('(' + _PHRASE_BY_TURN + ') || ' + q(' ') + ' || text')} AS text "
    "FROM conversations), comments AS (SELECT * FROM raw_comments WHERE text <> '')"
)
SCORED_COMMENTS = f"{COMMENTS}, {scores('comments', 'comment_id')}, {JUDGED}"
SUMMARY_COLUMNS = (
    f"{n_if(q('Toxic') + ' = prediction')} AS toxic_comments, "
    f"{n_if(q('Non-Toxic') + ' = prediction')} AS non_toxic_comments, "
    + ", ".join(f"{n_if(f'{label}_score >= 0.5')} AS {label}_count" for label in K.LABELS)
)
VIDEO_SUMMARY = (
    f"{SCORED_COMMENTS}, counted AS (SELECT user_id, video_id, {SUMMARY_COLUMNS} "
    "FROM judged GROUP BY ALL), summary AS (SELECT *, toxic_comments + non_toxic_comments "
    "AS total_comments FROM counted)"
)


def both_pct(total: str, digits: int) -> str:
    return (
        f"{pct('toxic_comments', total, digits)} AS toxic_percentage, "
        f"{pct('non_toxic_comments', total, digits)} AS non_toxic_percentage"
    )


# --- evaluation -------------------------------------------------------------

LABELLED = (
    f"{PHRASED}, labelled AS (SELECT phrased.*, quality, toxic FROM phrased JOIN labels "
    "USING (doc_id))"
)
LABEL_TRUTHS = {
    "toxic": "toxic",
    "insult": "(source IN ('src0', 'src1', 'src6', 'src9'))::INTEGER",
    "obscene": "toxic * (1 - quality)",
    "severe_toxic": "greatest(toxic * (1 - quality), (source = 'src17')::INTEGER)",
    "threat": "(source IN ('src2', 'src17', 'src19'))::INTEGER",
    "identity_hate": "(source IN ('src3', 'src18'))::INTEGER",
}
PAIRS = f"{LABELLED}, {tweets('labelled')}, pairs AS (SELECT lang, {TRUTH} AS label, final_class AS prediction FROM classified)"


def per_class_sql(by: str = "", source: str = "pairs") -> str:
    lead = f"{by}, " if by else ""
    return (
        "classes(class) AS (VALUES (0), (1), (2)), "
        f"tallies AS (SELECT {lead}class, {n_if('label = class AND prediction = class')} "
        f"AS hits, {n_if('label = class')} AS support, "
        f"{n_if('prediction = class')} AS predicted FROM {source} CROSS JOIN classes "
        f"GROUP BY ALL), "
        "pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hits::DOUBLE / predicted "
        "END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hits::DOUBLE / support END "
        "AS recall FROM tallies), "
        "per_class AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * "
        "precision * recall / (precision + recall) END AS f1 FROM pr)"
    )


OVERALL = (
    "sum(support)::BIGINT AS rows, round_even(sum(hits)::DOUBLE / sum(support), 6) AS "
    "accuracy, " + ", ".join(
        f"round_even(avg({m}) FILTER (WHERE support + predicted > 0), 6) AS {n}_macro"
        for m, n in (("precision", "precision"), ("recall", "recall"), ("f1", "f1"))
    )
)
MULTI = (
    f"{LABELLED}, {scores('labelled')}, long AS (" + " UNION ALL ".join(
        f"SELECT {q(label)} AS label_name, {truth} AS label, {label}_flagged AS prediction "
        "FROM scored"
        for label, truth in LABEL_TRUTHS.items()
    ) + "), cells AS (SELECT label_name, " + ", ".join(
        f"{n_if(f'label = {a} AND prediction = {p}')} AS {n}"
        for a, p, n in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn"))
    ) + " FROM long GROUP BY ALL), pr AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 "
    "THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 "
    "ELSE tp::DOUBLE / (tp + fn) END AS recall, 0.5 AS threshold FROM cells), multi AS "
    "(SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / "
    "(precision + recall) END AS f1 FROM pr)"
)
TRAINING = (
    f"training AS (SELECT doc_id AS row_key, {TRUTH} AS class, text AS tweet "
    "FROM documents JOIN labels USING (doc_id))"
)


def split_sql(source: str) -> str:
    return (
        "sized AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('42:' || "
        "row_key)) AS rn, count(*) OVER (PARTITION BY class) AS n "
        f"FROM {source}), held AS (SELECT *, ceil(n * 0.2)::BIGINT AS h FROM sized), "
        "split AS (SELECT *, CASE WHEN rn <= n - h THEN 'train' WHEN rn <= n - h + "
        "floor(h * 0.5) THEN 'val' ELSE 'test' END AS split FROM held)"
    )


# --- the queries ------------------------------------------------------------

ORACLES: dict[str, str] = {}
O = ORACLES

O["clean_text"] = f"WITH {PHRASED} SELECT doc_id, {clean_tweet('text')} AS cleaned FROM phrased"
O["collapse_ws"] = f"SELECT doc_id, {collapse('text')} AS cleaned FROM documents"
O["strip_urls"] = f"WITH {PHRASED} SELECT doc_id, {urls('text')} AS stripped FROM phrased"
O["strip_mentions"] = f"WITH {PHRASED} SELECT doc_id, {mentions('text')} AS stripped FROM phrased"
O["normalize_text"] = f"WITH {PHRASED} SELECT doc_id, {normalize('text')} AS normalized FROM phrased"
O["rule_text"] = f"WITH {PHRASED} SELECT doc_id, {reduce_text('text')} AS reduced FROM phrased"


def _decode_page(x: str) -> str:
    for _ in range(2):
        for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
            x = f"replace({x}, {q(entity)}, {q(char)})"
        x = f"regexp_replace({x}, '&amp;?', '&', 'g')"
    return x


O["html_decode"] = f"SELECT page_id, {_decode_page('html')} AS decoded FROM pages"
O["rule_flags"] = (
    f"WITH {PHRASED}, n AS (SELECT doc_id, {normalize('text')} AS t FROM phrased), f AS "
    f"(SELECT doc_id, {', '.join(f'{r(chr(116))} AS {n}' for n, r in RULES.items())} FROM n) "
    f"SELECT *, {first_rule({r: r for r in RULES}, 'none')} AS first_rule FROM f"
)
O["resolve_language"] = (
    f"SELECT doc_id, CASE WHEN {collapse('text')} = '' OR "
    f"len(string_split({collapse('text')}, ' ')) < 4 THEN 'en' ELSE coalesce(lang, 'en') END "
    "AS language FROM documents"
)
O["video_id"] = (
    "WITH k AS (SELECT page_id, url, substr(md5(url), 1, 11) AS key FROM pages), "
    "forms(form, strict_ok, host_ok, any_ok) AS (VALUES ('bare', 1, 1, 0), "
    "('watch', 1, 1, 1), ('second', 0, 1, 1), ('long', 1, 2, 0), ('short', 1, 1, 1), "
    "('embed', 0, 1, 1), ('shorts', 0, 1, 1), ('other', 0, 0, 1), ('schemeless', 1, 0, 1), "
    "('page', 0, 0, 0)) SELECT page_id, form, "
    "CASE strict_ok WHEN 1 THEN key ELSE 'none' END AS strict, "
    "CASE host_ok WHEN 1 THEN key WHEN 2 THEN key || 'xyz' ELSE 'none' END AS by_host, "
    "CASE any_ok WHEN 1 THEN key ELSE 'none' END AS any_host FROM k CROSS JOIN forms"
)
O["safe_cast"] = (
    "WITH r AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN value::VARCHAR "
    "WHEN 'click' THEN json_extract_string(props, '$.k') WHEN 'signup' THEN 'NaN' "
    "ELSE event_type END AS raw FROM events) SELECT id, CASE WHEN regexp_matches(raw, "
    "'^[+-]?[0-9]+$') THEN raw::BIGINT ELSE 0 END AS as_int, CASE WHEN raw = 'NaN' THEN 0.0 "
    "ELSE coalesce(TRY_CAST(raw AS DOUBLE), 0.0) END AS as_float FROM r"
)
O["is_positive"] = (
    "SELECT event_id AS id, value >= 0.5 AS by_number, event_type IN ('view', 'signup') "
    "AS by_word FROM events"
)
O["label_aliases"] = (
    f"WITH {HISTORY} SELECT id, " + ", ".join(
        f"coalesce({jget(label)}, {jget(ODD_NAMES.get(label, label))}, 0.0) AS {label}"
        for label in K.LABELS
    ) + " FROM parsed"
)
O["json_roundtrip"] = (
    f"WITH {HISTORY} SELECT id, len(json_keys(labels))::INTEGER AS n_labels, "
    f"coalesce({jget('toxic')}, 0.0) AS toxic, "
    "coalesce(json_extract_string(labels, '$.hate_category'), 'none') AS hate_category "
    "FROM parsed"
)
O["text_column"] = "SELECT doc_id, text FROM documents"
O["normalize_export"] = (
    "SELECT text, toxic AS toxicity, toxic AS insult, quality AS threat, quality AS "
    "identity_attack, 'twitter' AS source FROM documents JOIN labels USING (doc_id)"
)
O["merge_sources"] = (
    f"WITH {SCORED_COMMENTS} SELECT text, toxic AS toxicity, 'twitter' AS source FROM documents "
    "JOIN labels USING (doc_id) UNION ALL SELECT text, toxic_flagged, 'youtube' FROM judged"
)
_LINES = (
    "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, "
    "unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"
)
O["flatten_threads"] = (
    f"WITH {_LINES} SELECT doc_id::VARCHAR AS video_id, CASE WHEN i = 0 THEN doc_id::VARCHAR "
    "ELSE doc_id || '.' || i END AS comment_id, CASE WHEN i = 0 THEN 'none' ELSE "
    "doc_id::VARCHAR END AS parent_id, CASE WHEN lang <> 'fr' THEN source ELSE 'Unknown' END "
    f"AS author, {strip('line')} AS text, 'youtube' AS source, CASE WHEN i = 0 THEN "
    f"'top_level' ELSE 'reply' END AS comment_type FROM lines WHERE {strip('line')} <> ''"
)
O["collected_comments"] = (
    f"WITH {_LINES} SELECT doc_id::VARCHAR AS video_id, CASE WHEN i = 0 THEN 'youtube' ELSE "
    "'youtube_reply' END AS source, line AS text FROM lines"
)
O["video_info"] = (
    "SELECT doc_id::VARCHAR AS video_id, text AS title, CASE WHEN lang <> 'de' "
    "THEN source ELSE '' END AS channel, '2024-01-02T03:04:05Z' AS published_at, n_chars AS "
    "view_count, CASE WHEN lang = 'en' THEN doc_id ELSE 0 END AS like_count, 0::BIGINT AS "
    "comment_count FROM documents WHERE source <> 'src0'"
)
O["validate_training"] = (
    "SELECT count(*) AS rows, " + n_if("source = 'src3'") + " AS null_text, 0::BIGINT AS "
    "bad_toxicity, " + n_if("toxic IS NULL") + " AS bad_insult, " + n_if("toxic = 1")
    + " AS bad_threat, " + n_if("quality IS NULL") + " AS bad_identity_attack "
    "FROM documents LEFT JOIN labels USING (doc_id)"
)
O["validate_text"] = (
    "WITH t AS (SELECT doc_id, CASE WHEN source = 'src5' THEN '  ' || chr(10) || ' ' WHEN "
    "source <> 'src6' THEN ' ' || chr(9) || text END AS text FROM documents), s AS (SELECT "
    f"doc_id, text, {strip('text')} AS st FROM t) SELECT doc_id, CASE WHEN text IS NULL THEN "
    "'not a string' WHEN st = '' THEN 'empty' WHEN length(st) > 10000 THEN 'too long' ELSE "
    "'ok' END AS reason, coalesce(length(st), -1)::INTEGER AS chars FROM s"
)
O["dedupe_keep_first"] = (
    f"WITH {USABLE} SELECT doc_id, n_chars, text FROM usable QUALIFY row_number() OVER "
    "(PARTITION BY text ORDER BY doc_id) = 1"
)
O["dedupe_report"] = (
    f"WITH {CLEANED} SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_kept, "
    "count(*) - count(DISTINCT text) AS rows_removed FROM cleaned"
)
O["stratified_split"] = (
    f"WITH {TRAINING}, cleaned AS (SELECT row_key, class, {clean_tweet('tweet')} AS tweet "
    "FROM training), deduped AS (SELECT * FROM cleaned WHERE tweet <> '' QUALIFY row_number() "
    f"OVER (PARTITION BY tweet ORDER BY row_key) = 1), {split_sql('deduped')} "
    "SELECT row_key, class, split FROM split"
)
O["split_sizes"] = (
    f"WITH {TRAINING}, {split_sql('training')} SELECT split, class, count(*) AS rows FROM "
    "split GROUP BY ALL"
)
O["split_overlap"] = f"WITH {TRAINING}, {split_sql('training')} SELECT " + ", ".join(
    f"(SELECT count(*) FROM (SELECT tweet FROM split WHERE split = {q(a)} INTERSECT SELECT "
    f"tweet FROM split WHERE split = {q(b)})) AS {a}_{b}"
    for a, b in (("train", "val"), ("train", "test"), ("val", "test"))
)
O["cleaning_report"] = (
    f"WITH {PHRASED} SELECT "
    + n_if(f"regexp_matches(text, {q(rf'(?i)https?://{NS}+|www[.]{NS}+')})") + " AS urls, "
    + n_if(f"regexp_matches(text, {q('@' + W + '+')})") + " AS mentions, "
    + n_if(f"regexp_matches(text, {q('(?i)' + OPEN + 'rt' + CLOSE)})") + " AS retweets, "
    + n_if(f"{strip('text')} = ''") + " AS empty, "
    "count(text) - count(DISTINCT text) AS duplicates FROM phrased"
)
O["class_distribution"] = (
    "WITH c(class) AS (VALUES (0), (1), (2), (3)) SELECT class, count(l.doc_id) AS rows "
    f"FROM c LEFT JOIN labels l ON {TRUTH} = class GROUP BY class"
)
O["class_weights"] = (
    f"WITH d AS ({O['class_distribution']}) SELECT class, rows, "
    "round_even((SELECT count(*) FROM labels)::DOUBLE / (4 * greatest(rows, 1)), 6) AS weight "
    "FROM d"
)
O["lexicon_scores"] = f"WITH {scores()} SELECT doc_id, {SCORE_LIST}, {FLAG_LIST} FROM scored"
_COUNTED = {
    "toxic": "idiot|moron|stupid", "severe_toxic": "scum", "obscene": "trash",
    "threat": "threat", "insult": "loser|clown", "identity_hate": "race",
}
O["bulk_score"] = (
    "WITH c AS (SELECT doc_id, " + ", ".join(
        f"1.0 / (1.0 + exp(1.0 - len(regexp_extract_all(text, {q(p)})))) AS {label}"
        for label, p in _COUNTED.items()
    ) + f", {strip('text')} = '' AS blank FROM documents) SELECT doc_id, " + ", ".join(
        f"CASE WHEN blank THEN 0.0 ELSE round_even({label}, 4) END AS {label}_score, CASE WHEN "
        f"NOT blank AND {label} >= 0.5 THEN 1 ELSE 0 END AS {label}_flagged"
        for label in K.LABELS
    ) + " FROM c"
)
O["bulk_verdict"] = (
    f"WITH {USABLE}, {scores('usable')}, {JUDGED} SELECT doc_id, CASE WHEN "
    "len(string_split(text, ' ')) < 4 THEN 'en' ELSE coalesce(lang, 'en') END AS language, "
    "prediction, confidence FROM judged"
)
O["verdict_any"] = f"WITH {scores()}, {JUDGED} SELECT doc_id, prediction, confidence FROM judged"
O["verdict_percent"] = (
    f"WITH {scores()} SELECT doc_id, greatest("
    + ", ".join(f"{label}_raw" for label in K.LABELS) + ") >= 0.5 AS overall_toxic, "
    + ", ".join(f"round_even({label}_raw * 100, 2) AS {label}_percent" for label in K.LABELS)
    + " FROM scored"
)
PRIMARY = (
    "primaried AS (SELECT *, CASE WHEN toxic_flagged = 1 THEN 'Toxic' ELSE 'Non-Toxic' END AS "
    "prediction, round_even(CASE WHEN toxic_flagged = 1 THEN toxic_score ELSE 1 - toxic_score "
    "END * 100, 2) AS confidence, concat_ws(', ', "
    + ", ".join(f"CASE WHEN {label}_flagged = 1 THEN {q(label)} END" for label in K.LABELS)
    + ") AS categories FROM scored)"
)
O["verdict_primary"] = (
    f"WITH {scores()}, {PRIMARY} SELECT doc_id, prediction, confidence, "
    "round_even(toxic_score * 100, 2) AS toxic_score, categories FROM primaried"
)
O["verdict_priority"] = (
    f"WITH {scores()}, {priority()} SELECT doc_id, prediction, confidence, hate_category, "
    "hate_speech_score, offensive_score FROM prioritised"
)
O["exclusion_rule"] = (
    f"WITH {PHRASED}, r AS (SELECT *, {reduce_text('text')} AS reduced FROM phrased), f AS "
    f"(SELECT *, {found('reduced', alternation(K.GROUP_PHRASES))} AND "
    f"{found('reduced', alternation(K.EXCLUSION_PHRASES))} AS fired FROM r), {scores('f')}, "
    f"{priority('(CASE WHEN fired THEN greatest(identity_hate_score, 0.95) ELSE identity_hate_score END)')} "
    "SELECT doc_id, fired, prediction, confidence, hate_category, identity_score AS "
    "identity_hate_score FROM prioritised"
)
_U = {
    label: f"coalesce({jget(label)}, "
    + (f"{jget(ODD_NAMES[label])}, " if label in ODD_NAMES else "") + "0.0)"
    for label in K.LABELS
}
O["three_class_v1"] = (
    f"WITH {HISTORY}, s AS (SELECT id, greatest({_U['identity_hate']}, {_U['threat']}, "
    f"{_U['severe_toxic']}) AS h, greatest({_U['toxic']}, {_U['obscene']}, {_U['insult']}) AS o "
    "FROM parsed), c AS (SELECT *, h >= 0.5 AND h >= o AS is_h, o >= 0.5 AS is_o FROM s) "
    "SELECT id, CASE WHEN is_h THEN 'Hate Speech' WHEN is_o THEN 'Offensive Language' ELSE "
    "'Neither' END AS category, CASE WHEN is_h THEN '01' WHEN is_o THEN '02' ELSE '03' END AS "
    "classification_id, round_even(CASE WHEN is_h THEN h WHEN is_o THEN o ELSE greatest(0.0, "
    "1.0 - greatest(h, o)) END, 4) AS confidence, h >= 0.5 AS hate_speech, o >= 0.5 AS "
    "offensive_language, h < 0.5 AND o < 0.5 AS neither, round_even(h, 4) AS hate_score, "
    "round_even(o, 4) AS offensive_score, round_even(greatest(0.0, 1.0 - greatest(h, o)), 4) "
    "AS neither_score FROM c"
)
O["three_class_v2"] = (
    f"WITH {scores()}, {priority()}, v AS (SELECT *, prediction = 'Hate Speech' AS is_h, "
    "CASE hate_category WHEN 'identity_hate' THEN identity_hate_score WHEN 'threat' THEN "
    f"threat_score WHEN 'severe_toxic' THEN severe_toxic_score ELSE {HATE} END AS h, "
    f"{OFFENSIVE} AS o, CASE WHEN category0 IS NOT NULL THEN category0 WHEN "
    f"identity_hate_score = {HATE} THEN 'identity_hate' WHEN threat_score = {HATE} THEN "
    f"'threat' ELSE 'severe_toxic' END AS hate_label, CASE WHEN toxic_score = {OFFENSIVE} THEN "
    f"'toxic' WHEN insult_score = {OFFENSIVE} THEN 'insult' ELSE 'obscene' END AS "
    "offensive_label FROM prioritised) SELECT doc_id, CASE WHEN is_h THEN 'Hate Speech' WHEN "
    "o >= 0.5 THEN 'Offensive Language' ELSE 'Neither' END AS category, CASE WHEN is_h THEN "
    "'01' WHEN o >= 0.5 THEN '02' ELSE '03' END AS classification_id, round_even(CASE WHEN "
    "is_h THEN greatest(h, confidence) WHEN o >= 0.5 THEN o ELSE greatest(0.0, 1.0 - "
    "greatest(h, o)) END, 4) AS confidence, round_even(h, 4) AS hate_score, round_even(o, 4) "
    "AS offensive_score, round_even(greatest(0.0, 1.0 - greatest(h, o)), 4) AS neither_score, "
    "hate_label, offensive_label FROM v"
)
O["softmax_class"] = (
    f"WITH {sums('documents')}, l AS (SELECT doc_id, {' + '.join(K.HATE_LABELS)} AS lh, "
    f"{' + '.join(K.OFFENSIVE_LABELS)} AS lo, {K.NEITHER_LOGIT}::DOUBLE AS ln FROM lex_sums), "
    "m AS (SELECT *, greatest(lh, lo, ln) AS t FROM l), e AS (SELECT doc_id, exp(lh - t) AS a, "
    "exp(lo - t) AS b, exp(ln - t) AS c FROM m), p AS (SELECT doc_id, a / (a + b + c) AS h, b "
    "/ (a + b + c) AS o, c / (a + b + c) AS n FROM e), k AS (SELECT *, CASE WHEN h >= o AND h "
    f">= n THEN 0 WHEN o >= n THEN 1 ELSE 2 END AS class_id FROM p) SELECT doc_id, class_id, "
    f"{NAME_OF.format(c='class_id')} AS label, round_even(CASE class_id WHEN 0 THEN h WHEN 1 "
    "THEN o ELSE n END, 6) AS confidence, round_even(h, 6) AS hate_score, round_even(o, 6) AS "
    "offensive_score, round_even(n, 6) AS neither_score FROM k"
)
O["rule_class"] = (
    f"WITH {PHRASED}, {tweets('phrased')} SELECT doc_id, model_class, final_class, "
    f"{NAME_OF.format(c='final_class')} AS prediction, '0' || (final_class + 1) AS "
    "classification_id, CASE WHEN final_class < 2 THEN 'Toxic' ELSE 'Non-Toxic' END AS "
    "toxicity, round_even(conf, 6) AS confidence, round_even(conf * 100, 2) AS "
    "confidence_percentage, round_even(pm, 6) AS model_confidence, round_even(ph, 6) AS "
    "hate_score, round_even(po, 6) AS offensive_score, round_even(pn, 6) AS neither_score, "
    "refined AS refinement_applied, method AS classification_method FROM classified"
)
O["tweet_history"] = (
    f"WITH {PHRASED}, {tweets('phrased')} SELECT doc_id AS user_id, 'en' AS language, "
    f"{NAME_OF.format(c='final_class')} AS prediction, round_even(conf, 6) AS confidence, "
    "'twitter' AS source, length(text)::INTEGER AS chars, round_even(ph, 6) AS hate, "
    "round_even(po, 6) AS offensive, round_even(pn, 6) AS neither FROM classified"
)
_TW = (
    "CASE tok " + " ".join(f"WHEN {q(t)} THEN {w}" for t, w in K.LEXICON["toxic"].items())
    + " ELSE 0.0 END"
)
O["token_weights"] = (
    f"WITH {PHRASED}, s AS (SELECT doc_id, string_split_regex(lower(text), "
    "'[^\\p{L}\\p{N}_]+') AS toks FROM phrased), t AS (SELECT doc_id, unnest(toks) AS tok, "
    "unnest(range(len(toks))) AS i FROM s), w AS (SELECT doc_id, tok, i, "
    f"({_TW})::DOUBLE AS w FROM t WHERE tok <> ''), n AS (SELECT *, sum(w) OVER (PARTITION BY "
    "doc_id) AS total FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "
    "w DESC, i) AS rank FROM n WHERE tok NOT IN ('you', 'are')) SELECT doc_id, rank::INTEGER "
    "AS rank, tok AS token, round_even(CASE WHEN total > 0 THEN w / total ELSE w END, 6) AS "
    "weight FROM r WHERE rank <= 25"
)
O["history_rows"] = (
    f"WITH {HISTORY} SELECT id, user_id, input_text, coalesce(language, 'en') AS language, "
    "prediction, confidence, 'csv' AS source, "
    f"coalesce({jget('insult')}, -1.0) AS insult, {STAMP} FROM parsed WHERE prediction NOT IN "
    "('Error', 'Model Unavailable')"
)
O["comment_summary"] = (
    f"WITH {VIDEO_SUMMARY} SELECT *, {both_pct('total_comments', 2)}, " + ", ".join(
        f"{pct(f'{label}_count', 'total_comments', 2)} AS {label}_share" for label in K.LABELS
    ) + " FROM summary"
)
O["analysis_rows"] = (
    f"WITH {VIDEO_SUMMARY} SELECT user_id, 'youtube' AS analysis_type, video_id AS source, "
    "total_comments AS total_items, toxic_comments AS toxic_items, non_toxic_comments AS "
    f"non_toxic_items, {pct('toxic_comments', 'total_comments', 2)} AS toxic_percentage, "
    "insult_count, '2024-01-30 00:00:00' AS created_at FROM summary"
)
O["titled_analysis_rows"] = (
    f"WITH {VIDEO_SUMMARY} SELECT user_id, 'YouTube' AS analysis_type, 'Video ' || video_id AS "
    "title, CASE WHEN toxic_comments > non_toxic_comments THEN 'Toxic' ELSE 'Non-Toxic' END AS "
    f"prediction, {pct('toxic_comments', 'total_comments', 2)} AS confidence, '[]' AS "
    "categories, video_id, total_comments, toxic_comments, non_toxic_comments FROM summary"
)
O["comment_rows"] = (
    f"WITH {SCORED_COMMENTS} SELECT video_id, comment_id, author, text AS comment_text, "
    "prediction, confidence, toxic_score AS toxic FROM judged"
)
O["erase_items"] = f"WITH {HISTORY} SELECT id, user_id FROM history WHERE NOT (confidence >= 0.95)"
O["erase_users"] = (
    f"WITH {HISTORY} SELECT id, user_id FROM history WHERE user_id NOT IN (SELECT user_id FROM "
    "events WHERE value > 150)"
)
O["recent_history"] = (
    f"WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) "
    "AS rank FROM history) SELECT user_id, rank::INTEGER AS rank, id, CASE WHEN "
    "length(input_text) > 60 THEN substr(input_text, 1, 60) || '...' ELSE input_text END AS "
    "preview, prediction, confidence FROM r WHERE rank <= 10"
)
O["history_listing"] = (
    f"WITH {HISTORY} SELECT id, user_id, prediction, len(json_keys(labels))::INTEGER AS "
    f"n_labels, {STAMP} FROM parsed"
)
O["history_search"] = (
    f"WITH {HISTORY} SELECT id, user_id, input_text, prediction, source FROM history WHERE "
    f"lower(input_text) LIKE '%longer%' AND {TOXIC} AND {SRC} = 'csv'"
)
O["history_page"] = (
    f"WITH {HISTORY} SELECT id, user_id, prediction FROM history WHERE id < 900 ORDER BY id "
    "DESC LIMIT 20"
)
O["comment_listing"] = (
    f"WITH {SCORED_COMMENTS} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER "
    "BY position) AS row_number, text, prediction, confidence, toxic_score FROM judged"
)
O["thread_listing"] = (
    f"WITH {_LINES}, kept AS (SELECT doc_id, i, doc_id || '.' || i AS comment_id, "
    f"{collapse('line')} AS text FROM lines WHERE {strip('line')} <> ''), "
    f"{scores('kept', 'comment_id')}, {JUDGED} SELECT doc_id::VARCHAR AS video_id, row_number() "
    "OVER (PARTITION BY doc_id ORDER BY i) AS row_number, comment_id, CASE WHEN i % 3 = 0 THEN "
    "'top_level' ELSE 'reply' END AS comment_type, text, prediction, confidence, toxic_score "
    "FROM judged"
)
for _name, _verdict in (("toxic_comments", "Toxic"), ("non_toxic_comments", "Non-Toxic")):
    O[_name] = (
        f"WITH {SCORED_COMMENTS} SELECT video_id, comment_id, text, confidence FROM judged "
        f"WHERE prediction = {q(_verdict)}"
    )
O["verdict_view"] = (
    f"WITH {SCORED_COMMENTS}, t AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS total FROM "
    "judged WHERE prediction = 'Toxic') SELECT 'Toxic Comments' AS heading, t.video_id, "
    "'Video ' || d.source AS video_title, total, comment_id, author, t.text, confidence FROM t "
    "LEFT JOIN documents d ON d.doc_id::VARCHAR = t.video_id"
)
O["verdict_totals"] = (
    f"WITH {SCORED_COMMENTS} SELECT author, prediction, count(*) AS total FROM judged GROUP BY ALL"
)
_TODAY = f"created_at::DATE = DATE '{AS_OF}'"
_BASIC = (
    f"count(*) AS total, {n_if(TOXIC)} AS toxic, {n_if(NON_TOXIC)} AS non_toxic, "
    f"{n_if(_TODAY)} AS today"
)
O["user_stats"] = (
    f"WITH {HISTORY}, s AS (SELECT user_id, {_BASIC} FROM history GROUP BY user_id) SELECT *, "
    f"{pct('toxic', 'total', 1)} AS toxicity_rate FROM s"
)
O["daily_activity"] = (
    f"WITH {HISTORY}, d AS (SELECT user_id, created_at::DATE AS d, count(*) AS total FROM "
    "history GROUP BY ALL) SELECT user_id, strftime(d, '%Y-%m-%d') AS activity_date, total "
    "FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d) <= 30"
)
O["daily_activity_all"] = (
    f"WITH {HISTORY}, d AS (SELECT user_id, created_at::DATE AS d, count(*) AS total FROM "
    "history GROUP BY ALL) SELECT user_id, strftime(d, '%Y-%m-%d') AS activity_date, total FROM d"
)
O["source_distribution"] = (
    f"WITH {HISTORY} SELECT user_id, upper(coalesce(nullif(source, ''), 'text')) AS source, "
    "count(*) AS rows FROM history GROUP BY ALL"
)
_CHANNELS = (
    n_if(f"{SRC} = 'twitter'") + " AS twitter, " + n_if(f"{SRC} = 'csv'") + " AS csv, "
    + n_if(f"{SRC} IN ('text', 'api')") + " AS text"
)
O["channel_counts"] = (
    f"WITH {HISTORY}, {TITLED}, h AS (SELECT user_id, {_CHANNELS} FROM history GROUP BY "
    "user_id), a AS (SELECT user_id, count(*) AS analyses, "
    + n_if("analysis_type = 'YouTube'") + " AS youtube FROM analyses GROUP BY user_id) "
    "SELECT * FROM h JOIN a USING (user_id)"
)
_LABEL_COUNTS = {label: n_if(f"{jget(label)} >= 0.5") for label in K.LABELS}
O["label_counts"] = (
    f"WITH {HISTORY} SELECT user_id, "
    + ", ".join(f"{c} AS {label}" for label, c in _LABEL_COUNTS.items())
    + " FROM parsed GROUP BY user_id"
)
O["dashboard"] = (
    f"WITH {HISTORY}, s AS (SELECT user_id, {_BASIC}, {_CHANNELS}, "
    + ", ".join(f"{c} AS {label}_count" for label, c in _LABEL_COUNTS.items())
    + f" FROM parsed GROUP BY user_id) SELECT *, {pct('toxic', 'total', 1)} AS toxicity_rate FROM s"
)
O["page_stats"] = (
    f"WITH {HISTORY}, s AS (SELECT user_id, count(*) AS total, "
    + n_if("prediction = 'Toxic'") + " AS toxic, " + n_if("prediction = 'Non-Toxic'")
    + " AS non_toxic FROM history GROUP BY user_id) SELECT *, "
    f"{pct('toxic', 'total', 1)} AS rate FROM s"
)
O["upload_summary"] = (
    f"WITH {HISTORY}, s AS (SELECT user_id, count(*) AS total, "
    + n_if("prediction = 'Toxic'") + " AS toxic, " + n_if("prediction = 'Non-Toxic'")
    + " AS safe, " + n_if("prediction IN ('Error', 'Model Unavailable')") + " AS errors, "
    + ", ".join(f"{c} AS {label}_count" for label, c in _LABEL_COUNTS.items())
    + f" FROM parsed GROUP BY user_id) SELECT *, {pct('toxic', 'total', 1)} AS toxic_rate, "
    f"{pct('safe', 'total', 1)} AS safe_rate FROM s"
)
O["scored_summary"] = (
    f"WITH {scores()}, {PRIMARY}, s AS (SELECT source, count(*) AS total_comments, "
    + n_if("prediction = 'Toxic'") + " AS toxic_comments, "
    + ", ".join(f"sum({label}_flagged)::BIGINT AS {label}_count" for label in K.LABELS)
    + " FROM primaried GROUP BY source), n AS (SELECT *, total_comments - toxic_comments AS "
    f"non_toxic_comments FROM s) SELECT *, {both_pct('total_comments', 2)} FROM n"
)
O["loose_summary"] = (
    "WITH s AS (SELECT count(*) AS total_comments, " + n_if("toxic >= 0.5")
    + " AS toxic_comments, 0::BIGINT AS severe_toxic_count, 0::BIGINT AS obscene_count, "
    "0::BIGINT AS threat_count, " + n_if("quality >= 0.5") + " AS insult_count, 0::BIGINT AS "
    "identity_hate_count FROM labels), n AS (SELECT *, total_comments - toxic_comments AS "
    "non_toxic_comments, toxic_comments AS toxic_count FROM s) "
    f"SELECT *, {both_pct('total_comments', 1)} FROM n"
)
O["history_stats"] = (
    f"WITH {TITLED}, s AS (SELECT user_id, count(*) AS total, " + n_if("prediction = 'Toxic'")
    + " AS toxic_rows, " + n_if("analysis_type = 'YouTube'") + " AS youtube, "
    "coalesce(sum(k) FILTER (WHERE event_type <> 'error'), 0)::BIGINT AS toxic, "
    "0::BIGINT AS severe_toxic, 0::BIGINT AS obscene, 0::BIGINT AS threat, "
    "coalesce(sum(k % 7) FILTER (WHERE event_type <> 'error'), 0)::BIGINT AS insult, "
    "0::BIGINT AS identity_hate FROM analyses GROUP BY user_id) SELECT *, total - toxic_rows "
    f"AS safe_rows, {pct('toxic_rows', 'total', 2)} AS toxic_rate FROM s"
)
O["source_summary"] = (
    f"WITH {USABLE}, {scores('usable')}, {JUDGED}, s AS (SELECT source, {SUMMARY_COLUMNS} FROM "
    "judged GROUP BY source), t AS (SELECT *, toxic_comments + non_toxic_comments AS "
    f"total_comments FROM s) SELECT *, {both_pct('total_comments', 2)} FROM t"
)
O["eval_overall"] = f"WITH {PAIRS}, {per_class_sql()} SELECT {OVERALL} FROM per_class"
O["eval_per_class"] = (
    f"WITH {PAIRS}, {per_class_sql()} SELECT class, hits, support, predicted, "
    "round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) "
    "AS f1 FROM per_class"
)
_WAVG = ", ".join(
    f"round_even(sum({m} * support) / sum(support), 4) AS {m}"
    for m in ("precision", "recall", "f1")
)
_AVG = ", ".join(f"round_even(avg({m}), 4) AS {m}" for m in ("precision", "recall", "f1"))
O["eval_report"] = (
    f"WITH {PAIRS}, {per_class_sql()} SELECT {NAME_OF.format(c='class')} AS name, "
    "round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, round_even(f1, 4) "
    "AS f1, support FROM per_class UNION ALL SELECT 'accuracy', -1.0, -1.0, "
    "round_even(sum(hits)::DOUBLE / sum(support), 4), sum(support)::BIGINT FROM per_class "
    f"UNION ALL SELECT 'macro avg', {_AVG}, sum(support)::BIGINT FROM per_class UNION ALL "
    f"SELECT 'weighted avg', {_WAVG}, sum(support)::BIGINT FROM per_class"
)
O["confusion_matrix"] = (
    f"WITH {PAIRS}, c(actual) AS (VALUES (0), (1), (2)) SELECT actual, " + ", ".join(
        f"count(label) FILTER (WHERE prediction = {p}) AS predicted_{p}" for p in K.CLASSES
    ) + " FROM c LEFT JOIN pairs ON label = actual GROUP BY actual"
)
O["multilabel_eval"] = (
    f"WITH {MULTI} SELECT label_name, tp, fp, fn, tn, support, round_even(precision, 6) AS "
    "precision, round_even(recall, 6) AS recall, threshold::DOUBLE AS threshold, "
    "round_even(f1, 6) AS f1 FROM multi"
)
O["multilabel_averages"] = (
    f"WITH {MULTI} SELECT round_even(2 * sum(tp)::DOUBLE / (2 * sum(tp) + sum(fp) + sum(fn)), "
    "6) AS f1_micro, round_even(avg(f1), 6) AS f1_macro, round_even(sum(f1 * support) / "
    "sum(support), 6) AS f1_weighted FROM multi"
)
O["roc_auc"] = (
    f"WITH {LABELLED}, {scores('labelled')}, long AS (" + " UNION ALL ".join(
        f"SELECT {q(label)} AS label_name, {truth} AS label, {label}_score AS score FROM scored"
        for label, truth in LABEL_TRUTHS.items()
    ) + "), ranks AS (SELECT *, rank() OVER (PARTITION BY label_name ORDER BY score) + "
    "(count(*) OVER (PARTITION BY label_name, score) - 1) / 2.0 AS r FROM long), agg AS (SELECT "
    "label_name, " + n_if("label = 1") + " AS positives, " + n_if("label = 0")
    + " AS negatives, sum(r) FILTER (WHERE label = 1) AS rs FROM ranks GROUP BY label_name) "
    "SELECT label_name, positives, negatives, round_even((rs - positives * (positives + 1) / "
    "2.0) / (positives::DOUBLE * negatives), 6) AS auc FROM agg"
)
_BY_BOTH = (
    "CASE WHEN source <> 'src0' THEN substr(source, 4, 1) END"
)
O["crossed_slices"] = (
    f"WITH {LABELLED}, {tweets('labelled')}, rows_of AS (SELECT lang, {_BY_BOTH} AS kind, "
    f"{TRUTH} AS label, final_class AS prediction FROM classified), crossed AS ("
    "SELECT 'lang' AS slice, lang, NULL AS kind, label, prediction FROM rows_of UNION ALL "
    "SELECT 'kind', NULL, kind, label, prediction FROM rows_of UNION ALL "
    "SELECT 'lang x kind', lang, kind, label, prediction FROM rows_of), "
    f"{per_class_sql('slice, lang, kind', 'crossed')}, o AS (SELECT slice, lang, kind, {OVERALL}, "
    "sum(hits)::DOUBLE / sum(support) AS acc FROM per_class GROUP BY slice, lang, kind), g AS "
    "(SELECT avg((label = prediction)::INTEGER) AS whole FROM rows_of) SELECT slice, lang, kind, "
    "rows, accuracy, precision_macro, recall_macro, f1_macro, round_even(acc - whole, 6) AS "
    "accuracy_gap FROM o CROSS JOIN g"
)
O["slice_metrics"] = (
    f"WITH {PAIRS}, {per_class_sql('lang')}, o AS (SELECT lang, {OVERALL}, "
    "sum(hits)::DOUBLE / sum(support) AS acc FROM per_class GROUP BY lang), g AS (SELECT "
    "avg((label = prediction)::INTEGER) AS whole FROM pairs) SELECT lang, rows, accuracy, "
    "precision_macro, recall_macro, f1_macro, round_even(acc - whole, 6) AS accuracy_gap FROM "
    "o CROSS JOIN g"
)
O["error_examples"] = (
    f"WITH {LABELLED}, usable AS (SELECT * REPLACE ({collapse('text')} AS text) FROM labelled "
    f"WHERE {collapse('text')} <> ''), {scores('usable')}, {JUDGED}, e AS (SELECT doc_id, "
    "confidence, CASE WHEN toxic = 0 AND prediction = 'Toxic' THEN 'false_positive' WHEN toxic "
    "= 1 AND prediction = 'Non-Toxic' THEN 'false_negative' END AS error_type FROM judged), r "
    "AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY confidence DESC, doc_id) "
    "AS rank FROM e WHERE error_type IS NOT NULL) SELECT error_type, rank::INTEGER AS rank, "
    "doc_id, confidence FROM r WHERE rank <= 5"
)
O["stream_history"] = (
    f"WITH {HISTORY} SELECT id, user_id, input_text, prediction, confidence, 'text' AS source, "
    f"{STAMP} FROM history WHERE prediction NOT IN ('Error', 'Model Unavailable')"
)
O["stream_then_erase"] = (
    f"WITH {HISTORY} SELECT user_id, input_text, prediction, confidence, 'text' AS source, "
    f"'events' AS run_id, {STAMP}, strftime(created_at::DATE, '%Y-%m-%d') AS created_date FROM "
    "history WHERE prediction NOT IN ('Error', 'Model Unavailable') AND confidence < 0.95 AND "
    "user_id NOT IN (SELECT user_id FROM events WHERE value > 150)"
)
O["training_epochs"] = (
    f"WITH {TRAINING}, cleaned AS (SELECT row_key, class, {clean_tweet('tweet')} AS tweet "
    "FROM training), deduped AS (SELECT * FROM cleaned WHERE tweet <> '' QUALIFY row_number() "
    f"OVER (PARTITION BY tweet ORDER BY row_key) = 1), {split_sql('deduped')}, "
    "c(class) AS (VALUES (0), (1), (2)), t AS (SELECT c.class, count(split.class) AS rows FROM c "
    "LEFT JOIN split ON c.class = split.class AND split = 'train' GROUP BY c.class) "
    "SELECT class, rows, round_even(sum(rows) OVER () / (3.0 * greatest(rows, 1)), 6) AS weight, "
    "4::BIGINT AS epochs, 1::BIGINT AS selected, round_even(ln(3.0::DOUBLE), 6) AS first_loss, "
    "(SELECT count(*) FROM split WHERE split = 'val') AS val_rows, true AS falling, true AS best "
    "FROM t"
)
_ERASED = (
    "(id % 3 = 2 OR user_id NOT IN (SELECT user_id FROM events WHERE value > 150))"
)
O["indexed_search"] = (
    f"WITH {HISTORY} SELECT user_id, input_text, prediction, source, 'run' || (id % 3) AS run_id "
    f"FROM history WHERE lower(input_text) LIKE '%a longer tail%' AND {TOXIC} AND {_ERASED}"
)
O["history_table_page"] = (
    f"WITH {HISTORY}, n AS (SELECT * REPLACE ((id % 3 + 1) * 1099511627776 + id - min(id) OVER "
    "(PARTITION BY id % 3) + 1 AS id), id % 3 AS run FROM history) SELECT id, user_id, input_text, "
    "prediction, source, 'run' || run AS run_id FROM n WHERE id < 3 * 1099511627776 + 50 "
    "ORDER BY id DESC LIMIT 100"
)
O["kept_dashboard"] = (
    f"WITH {HISTORY}, s AS (SELECT user_id, {_BASIC}, {_CHANNELS}, "
    + ", ".join(f"{c} AS {label}_count" for label, c in _LABEL_COUNTS.items())
    + f" FROM parsed WHERE {_ERASED} GROUP BY user_id) SELECT *, "
    f"{pct('toxic', 'total', 1)} AS toxicity_rate FROM s"
)
O["upload_then_recent"] = (
    f"WITH {USABLE}, {scores('usable')}, {JUDGED}, r AS (SELECT *, row_number() OVER (ORDER BY "
    "doc_id % 2 DESC, doc_id DESC) AS rank FROM judged) SELECT 7::BIGINT AS user_id, "
    "rank::INTEGER AS rank, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE "
    "text END AS preview, CASE WHEN len(string_split(text, ' ')) < 4 THEN 'en' ELSE "
    "coalesce(lang, 'en') END AS language, prediction, confidence, 'csv' AS source, "
    "'2024-01-30 1' || (doc_id % 2) || ':00:00' AS created_at FROM r WHERE rank <= 1000"
)
O["failed_scores"] = (
    f"WITH {USABLE}, s AS (SELECT source, length(text) % 50 IN (7, 9) AS bad, length(text) % 10 "
    ">= 5 AS hit FROM usable), c AS (SELECT source, count(*) AS total, "
    + n_if("hit AND NOT bad") + " AS toxic, " + n_if("NOT hit AND NOT bad") + " AS safe, "
    + n_if("bad") + " AS errors, " + n_if("hit AND NOT bad") + " AS toxic_count, "
    + n_if("NOT bad") + " AS saved FROM s GROUP BY source) SELECT *, "
    f"{pct('toxic', 'total', 1)} AS toxic_rate, {pct('safe', 'total', 1)} AS safe_rate FROM c"
)
O["stream_daily"] = (
    f"WITH {HISTORY} SELECT strftime(created_at::DATE, '%Y-%m-%d') AS activity_date, user_id, "
    f"count(*) AS total, {n_if(TOXIC)} AS toxic, {n_if(NON_TOXIC)} AS non_toxic FROM history "
    "GROUP BY created_at::DATE, user_id"
)
O["stream_scores"] = (
    f"WITH {USABLE}, {scores('usable')}, {JUDGED} SELECT doc_id AS user_id, text AS input_text, "
    "CASE WHEN len(string_split(text, ' ')) < 4 THEN 'en' ELSE coalesce(lang, 'en') END AS "
    "language, prediction, confidence, toxic_score AS toxic FROM judged"
)
O["stream_daily_folded"] = O["stream_daily"]
_ALONE = sub(sub("text", rf"({W})([rR][tT])", r"\1zqzq\2"), rf"([rR][tT])({W})", r"\1zqzq\2")
_CUT = sub(_ALONE, rf"(?i)\brt\b{S}*:?{S}*")
O["strip_retweet_words"] = (
    f"WITH {PHRASED} SELECT doc_id, replace({_CUT}, 'zqzq', '') AS cleaned FROM phrased"
)
O["published_days"] = (
    "SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS total FROM events GROUP BY 1"
)
O["csv_sheets"] = (
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  Café ' || text ELSE "
    r"regexp_replace('  Café ' || text, '[^\x{0}-\x{ff}]', '?', 'g') END AS text, lang, source FROM documents"
)
