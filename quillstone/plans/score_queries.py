"""Queries over features, scores and classification."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import scoring as S

_TAIL = {0: " Roll 2d6 and you gain advantage.", 1: " The goblin dragon has 3 hit points; you can move.", 2: "\nLOUD\nLINES\nHERE", 3: ""}
_DOCS = "d AS (SELECT doc_id, text || CASE doc_id % 4 " + " ".join("WHEN {} THEN '{}'".format(k, v.replace("\n", "' || chr(10) || '")) for k, v in _TAIL.items()) + " END AS text FROM documents)"


def _docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat("text", F.element_at(F.array(*map(F.lit, _TAIL.values())), (F.col("doc_id") % 4 + 1).cast("int"))).alias("text"))


def _hits(x: str, ms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, '{m}')::INT" for m in ms) + ")"


def _any(x: str, ms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in ms) + ")"


def _n(x: str, *ps: str) -> str:
    return "(" + " + ".join("len(regexp_extract_all({}, '{}'))".format(x, p.replace("'", "''")) for p in ps) + ")"


_ED = "(?:$|[^a-z0-9_\\x{80}-\\x{10FFFF}])"
_BD = "(?:^|[^a-z0-9_\\x{80}-\\x{10FFFF}])"
_RULE = f"""r0 AS (SELECT doc_id, trim(text) AS x, lower(trim(text)) AS low FROM d), r1 AS (SELECT *, (CASE WHEN regexp_matches(low, '{_BD}(?:d(?:2|3|4|6|8|10|12|20|100)|\\d+d\\d+){_ED}') THEN 2.0 ELSE 0 END + {_hits('low', S.RULE_TOKENS)} - 0.5 * {_hits('low', S.OTHER_TOKENS)}
 + CASE WHEN regexp_matches(low, '{_BD}you (can|may|make|gain|add|have){_ED}') THEN 0.4 ELSE 0 END)::DOUBLE AS s FROM r0),
f AS (SELECT doc_id, {_n('low', '[\\p{L}\\p{N}_]+')} AS n_words, {_n('low', 'https?://\\S+|www\\.\\S+')} AS urls, {_n('x', '[;:,.!?]')} AS punct, len(list_filter(string_split(x, chr(10)), lambda l: trim(l) <> '' AND upper(trim(l)) = trim(l))) AS caps_lines,
 s - CASE WHEN {_n('low', '[0-9]+')} > 24 AND s < 1 THEN 0.5 ELSE 0 END AS rulesyness FROM r1),
g AS (SELECT doc_id, n_words, urls / greatest(1, n_words) AS url_density, punct / greatest(1, n_words) AS punct_density, caps_lines, rulesyness FROM f),
q AS (SELECT *, (6 + (n_words >= 40)::INT + (n_words <= 400)::INT + (url_density <= 0.02)::INT + (punct_density >= 0.005)::INT + (caps_lines <= 2)::INT + (rulesyness >= 0.5)::INT) / 14.0 AS posterior FROM g) """


@query(f"WITH {_DOCS}, {_RULE} SELECT doc_id, n_words::BIGINT AS n_words, round(url_density, 6) AS url_density, round(punct_density, 6) AS punct_density, caps_lines::BIGINT AS caps_lines FROM q")
def text_features(t: Tables) -> DataFrame:
    return S.features(_docs(t)).select("doc_id", "n_words", F.round("url_density", 6).alias("url_density"), F.round("punct_density", 6).alias("punct_density"), "caps_lines")


@query(f"WITH {_DOCS}, {_RULE} SELECT doc_id, round(rulesyness, 6) AS rulesyness FROM q")
def rules_score(t: Tables) -> DataFrame:
    return S.features(_docs(t)).select("doc_id", F.round("rulesyness", 6).alias("rulesyness"))


@query(f"WITH {_DOCS}, {_RULE} SELECT doc_id, round(posterior, 6)::DOUBLE AS posterior, n_words < 40 AS too_short, n_words > 400 AS too_long, caps_lines > 2 AS capsy, rulesyness < 0.5 AS low_rulesyness FROM q")
def quality_posterior(t: Tables) -> DataFrame:
    q = S.quality(S.features(_docs(t)))
    return q.select("doc_id", F.round("posterior", 6).alias("posterior"), *[F.col(f"flags.{k}").alias(k) for k in ("too_short", "too_long", "capsy", "low_rulesyness")])


@query(f"WITH {_DOCS}, {_RULE} SELECT doc_id FROM q WHERE posterior >= 0.7")
def quality_gate(t: Tables) -> DataFrame:
    return S.quality(S.features(_docs(t))).filter("posterior >= 0.7").select("doc_id")


_TALK = {0: "\nDM: roll initiative\nAnn: I attack 2d6 and hit\nSession 4 recap", 1: "\nArmor Class 12 Hit Points 9 Challenge Rating 3 Legendary Actions", 2: "\n| a | b |\nwe fought the party", 3: ""}
_CONV = "c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) || CASE conv_id % 4 " + " ".join("WHEN {} THEN '{}'".format(k, v.replace("\n", "' || chr(10) || '")) for k, v in _TALK.items()) + " END AS text, CASE conv_id % 5 WHEN 0 THEN 'Monster list' ELSE 'x' END AS title FROM conversations GROUP BY conv_id)"
_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
_TF = f"""t AS (SELECT conv_id, {_WORDS} AS n_words, {', '.join(f'{_n("text", *ps)} AS {k}' for k, ps in S.TRANSCRIPT_COUNTS.items())}, {_hits('lower(text)', S.FOR_TRANSCRIPT)} AS pos_kw_hits, {_hits('lower(text)', S.AGAINST_TRANSCRIPT)} AS neg_kw_hits,
 regexp_matches(title, '(?i)(Statblock|Bestiary|Monster|Class|Subclass|NPC|Feats?)') AS title_object_cue FROM c)"""


def _transcripts(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))  # one conversation's turns
    text = F.concat(F.array_join(F.transform("turns", lambda x: x["text"]), "\n"), F.element_at(F.array(*map(F.lit, _TALK.values())), (F.col("conv_id") % 4 + 1).cast("int")))
    c = t.conversations.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", text.alias("text"), F.when(F.col("conv_id") % 5 == 0, "Monster list").otherwise("x").alias("title"))
    return S.transcript_features(c, F.col("text"), F.col("title")).drop("text", "title")


@query(f"WITH {_CONV}, {_TF} SELECT conv_id, n_words::BIGINT AS n_words, dialogue_lines::BIGINT AS dialogue_lines, dice_hits::BIGINT AS dice_hits, session_hits::BIGINT AS session_hits, statblock_hits::BIGINT AS statblock_hits, table_hits::BIGINT AS table_hits, pos_kw_hits::BIGINT AS pos_kw_hits, neg_kw_hits::BIGINT AS neg_kw_hits, title_object_cue FROM t")
def transcript_features(t: Tables) -> DataFrame:
    return _transcripts(t)


def _step(name: str, steps: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {name} >= {n} THEN {p}" for n, p, _ in steps) + (" WHEN statblock_hits >= 1 AND dialogue_lines <= 2 THEN -0.7" if name == "statblock_hits" else "") + " ELSE 0 END"


def _ll(name: str, full: int, p1: float, p0: float, against: bool) -> str:
    k = f"least(1.0::DOUBLE, {name} / {full}.0)"
    k = f"(1 - {k})" if against else k
    return f"({k} * ln({p1 / p0!r}::DOUBLE) + (1 - {k}) * ln({(1 - p1) / (1 - p0)!r}::DOUBLE))"


_CLASS = f"""b AS (SELECT *, ({' + '.join(_step(k, v) for k, v in S.HEURISTIC.items())} - CASE WHEN title_object_cue THEN 0.8 ELSE 0 END)::DOUBLE AS base,
 exp(CASE WHEN title_object_cue THEN ln({0.3 / 0.7!r}::DOUBLE) ELSE ln({0.7 / 0.3!r}::DOUBLE) END + {' + '.join(_ll(*x) for x in S.BAYES)}) AS bf10,
 (SELECT min(abs(a - dialogue_lines) / 12 + abs(b - dice_hits) / 6) FROM (VALUES (2.0), (5.0), (8.0), (12.0)) x(a), (VALUES (0.0), (1.0), (3.0), (6.0)) y(b)) AS near FROM t),
e AS (SELECT *, CASE WHEN n_words < 120 THEN 0.05 ELSE (0.6 * greatest(0.0, least(1.0, 0.5 + base / 6)) + 0.4 * bf10 / (1 + bf10)) * CASE WHEN near <= 1.2 THEN 1 ELSE 0.85 END END AS confidence FROM b)"""


@query(f"WITH {_CONV}, {_TF}, {_CLASS} SELECT conv_id, round(base, 6) AS base, round(bf10, 6) AS bf10, round(confidence::DOUBLE, 6) AS confidence, n_words >= 120 AND (confidence >= 0.55 OR (base >= 0.6 AND bf10 > 2)) AS is_target FROM e")
def transcript_class(t: Tables) -> DataFrame:
    return S.classify_transcript(_transcripts(t)).select("conv_id", F.round("base", 6).alias("base"), F.round("bf10", 6).alias("bf10"), F.round("confidence", 6).alias("confidence"), "is_target")


@query("WITH n AS (SELECT conv_id, turn, (turn * 3) % 14 AS a, conv_id % 9 AS b FROM conversations) SELECT conv_id, turn, round((SELECT min(abs(x - a) / 12 + abs(y - b) / 6) FROM (VALUES (2.0), (5.0), (8.0), (12.0)) p(x), (VALUES (0.0), (1.0), (3.0), (6.0)) q(y))::DOUBLE, 6) AS nearest, round((a - (a - b) * pow(0.9, 5))::DOUBLE, 6) AS moment FROM n")
def abc_msm_accept(t: Tables) -> DataFrame:
    a, b = (F.col("turn") * 3) % 14, F.col("conv_id") % 9
    near = F.array_min(F.array(*[F.abs(F.lit(x) - a) / 12 + F.abs(F.lit(y) - b) / 6 for x in (2.0, 5.0, 8.0, 12.0) for y in (0.0, 1.0, 3.0, 6.0)]))
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(5)), b.cast("double"), lambda acc, _: acc - 0.1 * (acc - a))
    return t.conversations.select("conv_id", "turn", F.round(near, 6).alias("nearest"), F.round(theta, 6).alias("moment"))


_ASK = {0: " I attack the goblin", 1: " move to slot 3", 2: " end turn", 3: " please describe and explain the town", 4: " cast fireball", 5: " prep an encounter", 6: ""}
_ASKED = "a AS (SELECT conv_id, turn, text || CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _ASK.items()) + " END AS text FROM conversations)"
_PAD = "' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' '"


def _asked(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.concat("text", F.element_at(F.array(*map(F.lit, _ASK.values())), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))).alias("text"))


def _firsts(groups: dict[str, tuple[str, ...]]) -> str:
    return "[" + ", ".join("CASE " + " ".join(f"WHEN contains(x, '{m}') THEN '{k}:{m.strip()}'" for m in ms) + " END" for k, ms in groups.items()) + "]"


@query(f"WITH {_ASKED}, p AS (SELECT conv_id, turn, {_PAD} AS x FROM a), c AS (SELECT conv_id, turn, list_filter({_firsts(S.UNSUPPORTED)}, lambda v: v IS NOT NULL) AS bad, list_filter({_firsts(S.SUPPORTED)}, lambda v: v IS NOT NULL) AS good FROM p) SELECT conv_id, turn, array_to_string(CASE WHEN len(bad) > 0 THEN bad ELSE good END, ',') AS found FROM c")
def capability_terms(t: Tables) -> DataFrame:
    return _asked(t).select("conv_id", "turn", F.array_join(S.capabilities(F.col("text")), ",").alias("found"))


_BAD = tuple(m for ms in S.UNSUPPORTED.values() for m in ms)
_ROUTE = f"""l AS (SELECT *, CASE WHEN {_any('x', _BAD)} THEN 'unsupported_capability' WHEN {_any('x', (' attack ', ' move ', ' end turn', ' pass turn'))} THEN 'mechanical_action' WHEN {_any('x', ('describe', 'narrate', 'look around', 'what happens'))} THEN 'narrative_request' WHEN {_any('x', ('whose turn', 'what do i see', 'where are we', 'how hurt'))} THEN 'informational_query' END AS live FROM p),
o AS (SELECT conv_id, turn, 'live_dm' AS mode, live AS subtask, CASE live WHEN 'unsupported_capability' THEN 0.93 WHEN 'mechanical_action' THEN CASE WHEN s THEN 0.94 ELSE 0.82 END WHEN 'narrative_request' THEN CASE WHEN s THEN 0.88 ELSE 0.72 END ELSE CASE WHEN s THEN 0.87 ELSE 0.7 END END AS confidence FROM l WHERE live IS NOT NULL
UNION ALL SELECT conv_id, turn, 'dm_prep', CASE WHEN {_any('x', ('npc', 'villain', 'innkeeper', 'blacksmith'))} THEN 'npc_brief' WHEN {_any('x', ('town', 'village', 'city', 'settlement', 'location'))} THEN 'town_brief' WHEN {_any('x', ('encounter', 'ambush', 'battle', 'fight', 'combat'))} THEN 'encounter_outline' WHEN {_any('x', ('quest', 'hook', 'rumor', 'lead'))} THEN 'quest_hook' ELSE 'session_prep_packet' END, 0.9 FROM l WHERE {_any('x', ('prep', 'prepare', 'outline', 'build', 'design', 'generate', 'refine'))}
UNION ALL SELECT conv_id, turn, 'player_teaching', CASE WHEN contains(x, 'practice') THEN 'practice_scenario' ELSE 'concept_explanation' END, 0.89 FROM l WHERE {_any('x', ('explain', 'teach', 'how do i', 'how does', 'what is', 'clarify', 'learn', 'practice'))}),
k AS (SELECT *, row_number() OVER w AS r, lead(confidence) OVER w AS next FROM o WINDOW w AS (PARTITION BY conv_id, turn ORDER BY confidence DESC, mode, subtask))"""


@query(f"WITH {_ASKED}, p AS (SELECT conv_id, turn, conv_id % 2 = 0 AS s, {_PAD} AS x FROM a), {_ROUTE} SELECT p.conv_id, p.turn, mode, subtask, confidence::DOUBLE AS confidence, coalesce(round(confidence - next, 6) < 0.1, false) AS ambiguous FROM p LEFT JOIN k ON p.conv_id = k.conv_id AND p.turn = k.turn AND k.r = 1")
def route_mode(t: Tables) -> DataFrame:
    return _asked(t).select("conv_id", "turn", S.route(F.col("text"), F.col("conv_id") % 2 == 0).alias("r")).select("conv_id", "turn", "r.*")


@query(f"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\battack\\b') THEN 'attack' WHEN regexp_matches(text, '(?i)\\bmove\\b(?:\\s+to)?(?:\\s+slot)?\\s+(-?\\d+)\\b') THEN 'move' WHEN regexp_matches(text, '(?i)\\b(?:end\\s+turn|end\\s+my\\s+turn|pass\\s+turn)\\b') THEN 'end_turn' WHEN {_any('lower(text)', ('describe', 'narrate', 'look around', 'what happens'))} THEN 'narrative' ELSE 'information' END AS kind, nullif(trim(regexp_extract(text, '(?i)\\battack\\b(?:\\s+(?:the\\s+)?)?([a-z0-9][a-z0-9 -]+)?', 1)), '') AS target, nullif(regexp_extract(text, '(?i)\\bmove\\b(?:\\s+to)?(?:\\s+slot)?\\s+(-?\\d+)\\b', 1), '')::INT AS slot FROM a")
def intent_kind(t: Tables) -> DataFrame:
    return _asked(t).select("conv_id", "turn", S.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.*")


@query(f"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN contains(lower(text), 'attack') THEN 'combat' WHEN contains(lower(text), 'move') OR contains(lower(text), 'slot') THEN 'movement' WHEN contains(lower(text), 'turn') THEN 'initiative' ELSE 'general' END AS concept, CASE WHEN regexp_matches(lower(text), 'simple|basic') THEN 'beginner' WHEN regexp_matches(lower(text), 'detail|advanced') THEN 'advanced' ELSE 'standard' END AS depth FROM a")
def concept_depth(t: Tables) -> DataFrame:
    low = F.lower("text")
    has = lambda w: F.contains(low, F.lit(w))
    concept = F.when(has("attack"), "combat").when(has("move") | has("slot"), "movement").when(has("turn"), "initiative").otherwise("general")
    depth = F.when(low.rlike("simple|basic"), "beginner").when(low.rlike("detail|advanced"), "advanced").otherwise("standard")
    return _asked(t).select("conv_id", "turn", concept.alias("concept"), depth.alias("depth"))


@query(f"WITH {_ASKED} SELECT conv_id, turn, array_to_string(regexp_extract_all(text || ' 2d6+3 and d20', '\\d*d\\d+(?:[+-]\\d+)?'), ',') AS dice FROM a")
def dice_mentions(t: Tables) -> DataFrame:
    return _asked(t).select("conv_id", "turn", F.array_join(F.regexp_extract_all(F.concat("text", F.lit(" 2d6+3 and d20")), F.lit(r"\d*d\d+(?:[+-]\d+)?"), F.lit(0)), ",").alias("dice"))


@query("WITH d AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' A hook and a setup; the climax.' WHEN 1 THEN ' twist, rising action, aftermath' ELSE '' END AS text FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'hook|overview') THEN 'hook' END, CASE WHEN regexp_matches(lower(text), 'setup|background') THEN 'setup' END, CASE WHEN regexp_matches(lower(text), 'rising action|complication') THEN 'rising' END, CASE WHEN regexp_matches(lower(text), 'twist|reveal') THEN 'twist' END, CASE WHEN regexp_matches(lower(text), 'climax|final battle') THEN 'climax' END, CASE WHEN regexp_matches(lower(text), 'aftermath|falling action') THEN 'falling' END, CASE WHEN regexp_matches(lower(text), 'resolution|epilogue') THEN 'resolution' END], lambda v: v IS NOT NULL), ',') AS acts FROM d")
def story_acts(t: Tables) -> DataFrame:
    x = F.lower(F.concat("text", F.when(F.col("doc_id") % 3 == 0, " A hook and a setup; the climax.").when(F.col("doc_id") % 3 == 1, " twist, rising action, aftermath").otherwise("")))
    acts = {"hook": "hook|overview", "setup": "setup|background", "rising": "rising action|complication", "twist": "twist|reveal", "climax": "climax|final battle", "falling": "aftermath|falling action", "resolution": "resolution|epilogue"}
    return t.documents.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(a)) for a, p in acts.items()])), ",").alias("acts"))


@query("WITH l(term, kind) AS (VALUES ('der', 'theme'), ('que', 'theme'), ('ing', 'tone'), ('zz', 'tone')) SELECT doc_id, kind, string_agg(term, ',' ORDER BY term) AS terms FROM documents JOIN l ON contains(lower(text), term) GROUP BY doc_id, kind")
def lexicon_hits(t: Tables) -> DataFrame:
    lexicon = {"theme": ("der", "que"), "tone": ("ing", "zz")}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_join(F.filter(F.array(*map(F.lit, v)), lambda m: F.contains(F.lower("text"), m)), ",").alias("terms")) for k, v in lexicon.items()])
    return t.documents.select("doc_id", F.inline(rows)).filter("terms <> ''")


_BLOCK = "'Armor Class ' || (10 + p_size % 9) || ' Hit Points ' || p_size || ' (' || (p_size % 5 + 1) || 'd8) Speed 30 ft. STR 1' || (p_size % 8) || ' DEX 12' || CASE p_size % 3 WHEN 0 THEN '' ELSE ' Challenge 2' END"


def _block() -> F.Column:
    s = F.col("p_size")
    return F.concat(F.lit("Armor Class "), 10 + s % 9, F.lit(" Hit Points "), s, F.lit(" ("), s % 5 + 1, F.lit("d8) Speed 30 ft. STR 1"), s % 8, F.lit(" DEX 12"), F.when(s % 3 == 0, "").otherwise(" Challenge 2"))


@query(f"WITH b AS (SELECT p_partkey, {_BLOCK} AS x FROM part) SELECT p_partkey, regexp_extract(x, 'Armor Class (\\d+)', 1)::INT AS ac, regexp_extract(x, 'Hit Points (\\d+)', 1)::INT AS hp, regexp_extract(x, 'Speed ([^.]*)\\.', 1) AS speed, regexp_extract(x, 'STR (\\d+)', 1)::INT AS str, nullif(regexp_extract(x, 'Challenge (\\d+)', 1), '') AS challenge FROM b")
def statblock_fields(t: Tables) -> DataFrame:
    x = F.col("x")
    get = lambda p: F.regexp_extract(x, p, 1)
    return t.part.select("p_partkey", _block().alias("x")).select("p_partkey", get(r"Armor Class (\d+)").cast("int").alias("ac"), get(r"Hit Points (\d+)").cast("int").alias("hp"), get(r"Speed ([^.]*)\.").alias("speed"), get(r"STR (\d+)").cast("int").alias("str"), F.nullif(get(r"Challenge (\d+)"), F.lit("")).alias("challenge"))


@query(f"WITH b AS (SELECT p_partkey, {_BLOCK} AS x FROM part), s AS (SELECT *, regexp_matches(x, 'Armor Class')::INT + regexp_matches(x, 'Hit Points')::INT + regexp_matches(x, 'Challenge')::INT + regexp_matches(x, 'STR 1[0-3]')::INT AS n FROM b) SELECT p_partkey, n::BIGINT AS signals FROM s WHERE n >= 3 AND regexp_matches(x, 'Speed')")
def statblock_keep(t: Tables) -> DataFrame:
    n = sum((F.col("x").rlike(p).cast("int") for p in ("Armor Class", "Hit Points", "Challenge", "STR 1[0-3]")), F.lit(0))
    return t.part.select("p_partkey", _block().alias("x")).withColumn("signals", n.cast("long")).filter((F.col("signals") >= 3) & F.col("x").rlike("Speed")).select("p_partkey", "signals")


@query("SELECT conv_id, turn, regexp_matches(x, '^\\s*(?:In the heart of|Once upon a time|As the sun|Deep within)') AS stock, NOT regexp_matches(x, '^\\s*(?:As an|Sure|Okay)') AS allowed FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'In the heart of ' WHEN 1 THEN ' As an aide ' ELSE '' END || text AS x FROM conversations)")
def stock_openers(t: Tables) -> DataFrame:
    x = F.concat(F.when(F.col("turn") % 4 == 0, "In the heart of ").when(F.col("turn") % 4 == 1, " As an aide ").otherwise(""), F.col("text"))
    return t.conversations.select("conv_id", "turn", x.rlike(r"^\s*(?:In the heart of|Once upon a time|As the sun|Deep within)").alias("stock"), (~x.rlike(r"^\s*(?:As an|Sure|Okay)")).alias("allowed"))


@query("SELECT doc_id, array_to_string(list_filter(['idiot', 'trash', 'scum'], lambda m: contains(lower(text), m)), ',') AS terms, coalesce(toxic >= 0.8, false) AS flagged, CASE WHEN coalesce(toxic >= 0.8, false) THEN 'drop' WHEN contains(lower(text), 'idiot') THEN 'flag' ELSE 'keep' END AS action FROM documents LEFT JOIN labels USING (doc_id)")
def content_screen(t: Tables) -> DataFrame:
    terms = F.filter(F.array(*map(F.lit, ("idiot", "trash", "scum"))), lambda m: F.contains(F.lower("text"), m))
    flagged = F.coalesce(F.col("toxic") >= 0.8, F.lit(False))
    action = F.when(flagged, "drop").when(F.contains(F.lower("text"), F.lit("idiot")), "flag").otherwise("keep")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.array_join(terms, ",").alias("terms"), flagged.alias("flagged"), action.alias("action"))


@query("SELECT doc_id, round(CASE WHEN length(x) >= 5 THEN (length(x) - 4 - len(list_distinct(list_transform(range(1, length(x) - 3), lambda i: substr(x, i, 5))))) / (length(x) - 4) ELSE 0 END, 6)::DOUBLE AS repetition FROM (SELECT doc_id, text AS x FROM documents)")
def char_repetition(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(S.repetition(F.col("text")), 6).alias("repetition"))


@query()
def gmm_split(t: Tables) -> DataFrame:
    """Two-component mixture over standardised features; the cluster with more words is 1."""
    f = S.features(t.documents.select("doc_id", "text")).withColumn("caps", F.col("caps_lines").cast("double")).withColumn("words", F.log1p(F.col("n_words").cast("double")))
    v = VectorAssembler(inputCols=["words", "punct_density", "caps"], outputCol="raw").transform(f)
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    model = GaussianMixture(k=2, seed=7, maxIter=20).fit(x)
    means = [g.mean[0] for g in model.gaussians]
    return model.transform(x).select("doc_id", (F.col("prediction") == F.lit(means.index(max(means)))).cast("int").alias("cluster"))


@query("WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS bought, count(*) FILTER (value < 10) AS low FROM events GROUP BY user_id) SELECT user_id, CASE WHEN low * 2 > n THEN 'error' WHEN bought = 0 THEN 'warning' WHEN n > 5 THEN 'success' ELSE 'info' END AS tone, n || ' events, ' || bought || ' bought' AS message FROM c")
def run_tone(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count_if(F.col("value") < 10).alias("low"))
    tone = F.when(F.col("low") * 2 > F.col("n"), "error").when(F.col("bought") == 0, "warning").when(F.col("n") > 5, "success").otherwise("info")
    return c.select("user_id", tone.alias("tone"), F.concat("n", F.lit(" events, "), "bought", F.lit(" bought")).alias("message"))
