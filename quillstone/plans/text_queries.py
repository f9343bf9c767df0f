"""Queries over text cleaning, tokens, hashes and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import hashing as H
from ..functions import text as T
from ..operators import grams

NL = "chr(10)"
#: Documents with deterministic noise behind the text, built alike in both engines.
_NOISE = {
    0: "\nSee https://example.org/a?b=1 now",
    1: "\nCopyright notice of the year",
    2: "\n<b>bold</b> text",
    3: "\n{ } ,",
    4: "\n•  bullet – dash",
    5: "\nwww.site.test page !!\n12",
    6: "\nsee c:\\data\\run.log and notes.txt or a::b::c  , output",
}
NOISY_SQL = "SELECT doc_id, source, lang, text || CASE doc_id % 7 " + " ".join("WHEN {} THEN '{}'".format(k, v.replace("\n", "' || chr(10) || '")) for k, v in _NOISE.items()) + " END AS text FROM documents"


def noisy(t: Tables) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(v) for v in _NOISE.values()]), (F.col("doc_id") % 7 + 1).cast("int"))
    return t.documents.select("doc_id", "source", "lang", F.concat("text", tail).alias("text"))


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A\s+|\s+\z', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


@query(
    """SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'H' || doc_id WHEN doc_id % 3 = 1 THEN source ELSE 'Document' END AS title
    FROM documents"""
)
def scan_project_documents(t: Tables) -> DataFrame:
    heading = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" H"), "doc_id")).otherwise(F.lit("  "))
    title = F.when(F.col("doc_id") % 3 == 1, F.col("source"))
    return t.documents.select("doc_id", "lang", "source", "n_chars", T.heading_or_title(heading, title).alias("title"))


_SANITIZE = f"""WITH d AS ({NOISY_SQL}),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'),
 '{T.TRIPLET}', ' ', 'g'), '{T.PATH}', ' ', 'g'), '{T.FILE_NAME}', ' ', 'g'), '{T.DRIVE}', ' ', 'g') AS x FROM d),
b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)),
 lambda l: trim(regexp_replace(regexp_replace({_strip('l')}, '(?i)\\b(?:{T.TOOL_TERMS})\\b', ' ', 'g'), '\\s+', ' ', 'g'), ' .,:;-_')), lambda l: l <> ''), chr(10)) AS x FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '!+', '!', 'g'), '[?]+', '?', 'g'), '[.]+', '.', 'g'), ',+', ',', 'g'), ':+', ':', 'g'), ';+', ';', 'g') AS x FROM b)
SELECT doc_id, {_strip("regexp_replace(regexp_replace(x, '\\s+([!?.,:;])', '\\1', 'g'), '[ \\t]+', ' ', 'g')")} AS text FROM c"""


@query(_SANITIZE)
def sanitize_lines(t: Tables) -> DataFrame:
    return noisy(t).select("doc_id", T.sanitize_content("text").alias("text"))


@query(
    f"""WITH f AS (SELECT doc_id, 'data/' || source || '/' || lang || '_report-' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.html.md' ELSE '' END AS name FROM documents
    UNION ALL SELECT -1, 'output manifest' UNION ALL SELECT -2, '   ' UNION ALL SELECT -3, 'a!!b??c.pdf'),
    b AS (SELECT doc_id, regexp_replace(list_extract(string_split({_strip('name')}, '/'), -1), '(?i)(?:\\.(?:{T.EXTENSIONS}))+\\z', '') AS x FROM f),
    c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(x, '_-.', '   '), '!+', '!', 'g'), '[?]+', '?', 'g'), '\\s+', ' ', 'g'), ' .,:;!?-_') AS x FROM b)
    SELECT doc_id, CASE WHEN x = '' OR regexp_matches(x, '(?i)\\A(?:{T.TOOL_TERMS})(?:\\s+(?:{T.TOOL_TERMS}))*\\z') THEN NULL ELSE x END AS title FROM c"""
)
def titles_sanitized(t: Tables) -> DataFrame:
    end = F.element_at(F.array(F.lit(".txt"), F.lit(".html.md"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    names = t.documents.select("doc_id", F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit("_report-"), "doc_id", end).alias("name"))
    more = t.spark.createDataFrame([(-1, "output manifest"), (-2, "   "), (-3, "a!!b??c.pdf")], "doc_id long, name string")
    return names.union(more).select("doc_id", T.sanitize_title("name").alias("title"))


@query(
    f"""WITH p AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN ' v1.2' WHEN 2 THEN '/x' ELSE '' END AS name FROM part)
    SELECT p_partkey, regexp_matches(name, '[\\\\/]') OR regexp_matches(name, '(?i).\\.(?:{T.EXTENSIONS})\\z') AS is_file FROM p"""
)
def filename_like(t: Tables) -> DataFrame:
    end = F.element_at(F.array(F.lit(".csv"), F.lit(" v1.2"), F.lit("/x"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", T.looks_like_filename(F.concat("p_name", end)).alias("is_file"))


def _mark(x: str) -> str:
    bullet, number = "\\A\\s*[•·●►▪-]\\s*", "\\A\\s*(\\d+[).]|\\(\\d+\\)|[a-z]\\))\\s+"
    d = f"regexp_replace({x}, '[–—]+', '-', 'g')"
    return f"CASE WHEN regexp_matches({d}, '{bullet}') THEN regexp_replace({d}, '{bullet}', '- ') ELSE regexp_replace({d}, '{number}', '\\1 ') END"


def _clean(x: str) -> str:
    hyphen = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '([\\p{{L}}\\p{{N}}_]+)-\\n([\\p{{L}}\\p{{N}}_]+)', '\\1\\2', 'g')"
    marked = f"array_to_string(list_transform({_lines(hyphen)}, lambda l: {_mark('l')}), chr(10))"
    return _strip(f"regexp_replace(regexp_replace({marked}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _boiler(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{p}')" for p in T.BOILERPLATE) + ")"


def _boilers(x: str) -> str:
    return "(" + " + ".join(f"contains(lower({x}), '{p}')::INT" for p in T.BOILERPLATE) + ")"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


_METRICS = f"""WITH d AS ({NOISY_SQL}), a AS (SELECT doc_id, text, {_clean('text')} AS one FROM d),
b AS (SELECT doc_id, text, list_filter(list_transform({_lines('one')}, lambda l: {_strip('l')}), lambda l: l <> '' AND NOT regexp_matches(l, '{T.WRAPPER_LINE}')) AS ls FROM a),
c AS (SELECT doc_id, text, len(list_filter(ls, lambda l: {_boiler('l')})) AS gone, array_to_string(list_transform(list_filter(ls, lambda l: NOT {_boiler('l')}), lambda l: regexp_replace(l, '{T.URL}', '', 'g')), chr(10)) AS kept FROM b),
e AS (SELECT doc_id, text, gone, {_clean('kept')} AS cleaned FROM c)
SELECT doc_id, cleaned, greatest(0, {_count('text', T.URL)} - {_count('cleaned', T.URL)})::BIGINT AS removed_urls, greatest(0, {_count('text', T.TAG)} - {_count('cleaned', T.TAG)})::BIGINT AS removed_html_tags,
 greatest(gone, {_boilers('text')} - {_boilers('cleaned')})::BIGINT AS removed_boilerplate, ({_words('cleaned')} - {_words('text')})::BIGINT AS token_delta,
 (length({_clean('cleaned')}) - length(cleaned))::BIGINT AS repeated_pass_delta, cleaned = text AS no_op_transform FROM e"""


def clean_with_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned text and what cleaning took away."""
    one = docs.withColumn("_one", T.clean_html_text("text"))
    prose = F.filter(F.transform(T.lines("_one"), lambda s: T.strip(s)), lambda s: (s != "") & ~s.rlike(T.WRAPPER_LINE))
    two = one.withColumn("_gone", F.size(F.filter(prose, T.has_boilerplate))).withColumn("cleaned", T.clean_html_text(T.keep_prose_lines("_one")))
    fewer = lambda pattern: F.greatest(F.lit(0), F.regexp_count("text", F.lit(pattern)) - F.regexp_count("cleaned", F.lit(pattern)))
    made = {
        "removed_urls": fewer(T.URL),
        "removed_html_tags": fewer(T.TAG),
        "removed_boilerplate": F.greatest(F.col("_gone"), T.count_boilerplate("text") - T.count_boilerplate("cleaned")),
        "token_delta": T.word_count("cleaned") - T.word_count("text"),
        "repeated_pass_delta": F.char_length(T.clean_html_text("cleaned")) - F.char_length("cleaned"),
    }
    return two.select("*", *[v.cast("long").alias(k) for k, v in made.items()], (F.col("cleaned") == F.col("text")).alias("no_op_transform")).drop("_one", "_gone")


@query(_METRICS)
def clean_text_metrics(t: Tables) -> DataFrame:
    return clean_with_metrics(noisy(t)).drop("text", "source", "lang")


@query(
    f"""WITH d AS (SELECT doc_id, unnest({_lines("text || chr(10) || 'A running head of pages' || chr(10) || 'A running  head of pages' || chr(10) || ' 12 ' || chr(10) || 'Index' || chr(10) || 'A running head of pages' || chr(10) || 'A running head of pages'")}) AS line, generate_subscripts({_lines("text || repeat(chr(10), 6)")}, 1) AS pos FROM documents),
    n AS (SELECT *, {_squeeze('line')} AS norm FROM d), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS c FROM n)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM c WHERE NOT (length(norm) >= 14 AND c >= 4) AND NOT regexp_matches(line, '\\A\\s*\\d+\\s*\\z') AND lower({_strip('line')}) NOT IN ('index', 'contents', 'table of contents') GROUP BY doc_id"""
)
def repeating_lines_removed(t: Tables) -> DataFrame:
    tail = "\nA running head of pages\nA running  head of pages\n 12 \nIndex\nA running head of pages\nA running head of pages"
    kept = t.documents.select("doc_id", T.drop_repeated_lines(T.lines(F.concat("text", F.lit(tail)))).alias("kept"))
    return kept.filter(F.size("kept") > 0).select("doc_id", T.join_lines(F.col("kept")).alias("text"))


@query(
    f"""WITH l AS (SELECT source, doc_id, list_filter(list_transform({_lines('text')}, lambda x: {_strip('x')}), lambda x: x <> '') AS ls FROM documents),
    e AS (SELECT DISTINCT source, doc_id, unnest(CASE WHEN len(ls) >= 3 THEN list_concat(ls[1:3], ls[-3:]) ELSE list_concat(ls[1:3], ls[-1:]) END) AS line FROM l),
    p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
    SELECT e.source, e.line, count(*) AS n_pages FROM e JOIN p USING (source) GROUP BY e.source, e.line, p.pages HAVING count(*) >= greatest(2, CAST(floor(0.05 * p.pages) AS BIGINT))"""
)
def header_footer_lines(t: Tables) -> DataFrame:
    ls = F.filter(F.transform(T.lines("text"), lambda s: T.strip(s)), lambda x: x != "")
    edge = F.array_union(F.slice("ls", 1, 3), F.when(F.size("ls") >= 3, F.slice("ls", -3, 3)).when(F.size("ls") > 0, F.slice("ls", -1, 1)).otherwise(F.slice("ls", 1, 1)))
    lines = t.documents.select("source", "doc_id", ls.alias("ls")).select("source", "doc_id", F.explode(edge).alias("line"))
    pages = t.documents.groupBy("source").agg(F.count("*").alias("pages"))
    found = lines.groupBy("source", "line").agg(F.count("*").alias("n_pages"))
    return found.join(pages, "source").filter(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(0.05 * F.col("pages")))).select("source", "line", "n_pages")


@query(
    """SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, substr(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80) AS slug,
    trim(regexp_replace(lower(p_brand), '[^a-z0-9_.:-]+', '-', 'g'), '-') AS identifier, replace('x\\' || p_brand, '\\', '/') AS path FROM part"""
)
def normalize_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.normalize_name("p_name").alias("name"), T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), T.identifier("p_brand").alias("identifier"), T.source_path(F.concat(F.lit("x\\"), "p_brand")).alias("path"))


@query(
    f"""WITH s AS (SELECT doc_id, string_split(regexp_replace({_squeeze('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
    e AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM s) SELECT doc_id, pos::BIGINT AS pos, sentence FROM e WHERE sentence <> ''"""
)
def sentence_explode(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{T.TOKEN.replace("'", "''")}')) AS t FROM documents) GROUP BY t""")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(T.tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(
    f"""WITH w AS (SELECT list_transform(regexp_extract_all(text, '{T.LETTER_WORD.replace("'", "''")}'), lambda x: lower(x)) AS w FROM documents),
    b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w) SELECT bigram, count(*) AS n FROM b GROUP BY bigram"""
)
def bigram_counts(t: Tables) -> DataFrame:
    return grams.pair_counts(t.documents, T.letter_tokens("text")).withColumnRenamed("pair", "bigram")


@query(
    f"""SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, substr(sha1(source || '/' || doc_id), 1, 16) AS ref_hash, sha1(substr(lower({_squeeze('text')}), 1, 5000)) AS dup_key,
    substr(sha1('v1::' || source || '::' || lang), 1, 12) AS prompt_hash FROM documents"""
)
def content_hashes(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", H.content_hash(F.col("text")).alias("content_hash"), H.short_sha1(F.concat_ws("/", "source", "doc_id")).alias("ref_hash"),
        H.duplicate_key(F.col("text")).alias("dup_key"), H.short_sha1(F.concat_ws("::", F.lit("v1"), "source", "lang"), 12).alias("prompt_hash"),
    )


@query(
    """WITH d AS (SELECT *, substr(sha1(source || '/' || doc_id), 1, 16) AS k FROM documents)
    SELECT doc_id, 'raw:' || source || ':' || k AS raw_id, 'chunk:' || source || ':' || k || ':' || lpad((doc_id % 12)::VARCHAR, 4, '0') AS chunk_id, sha1(source || ':1-2:' || lang || ':' || substr(text, 1, 60)) AS rule_id FROM d"""
)
def record_ids(t: Tables) -> DataFrame:
    k = H.short_sha1(F.concat_ws("/", "source", "doc_id"))
    return t.documents.select(
        "doc_id", H.record_id("raw", F.col("source"), k).alias("raw_id"), H.record_id("chunk", F.col("source"), k, F.col("doc_id") % 12).alias("chunk_id"),
        F.sha1(F.concat(F.col("source"), F.lit(":1-2:"), F.col("lang"), F.lit(":"), F.substring("text", 1, 60))).alias("rule_id"),
    )


@query(
    """WITH d AS (SELECT o_orderkey, unnest(range(0, 3)) AS i FROM orders),
    r AS (SELECT o_orderkey, (('0x' || substr(sha256('17:o' || o_orderkey || ':' || i), 1, 16))::UHUGEINT % 20)::BIGINT + 1 AS roll FROM d) SELECT o_orderkey, sum(roll)::BIGINT + 2 AS total, min(roll) AS least FROM r GROUP BY o_orderkey"""
)
def dice_rolls(t: Tables) -> DataFrame:
    ns = F.concat(F.lit("o"), F.col("o_orderkey"))
    rolls = F.array(*[H.die(F.lit(17), ns, F.lit(i), F.lit(20)) for i in range(3)])
    return t.orders.select("o_orderkey", F.aggregate(rolls, F.lit(2).cast("long"), lambda a, x: a + x).alias("total"), F.array_min(rolls).alias("least"))


@query("""SELECT o_orderkey, ['calm', 'storm', 'fog'][(('0x' || substr(sha256('w' || o_orderkey), 1, 2))::INT % 3) + 1] AS choice FROM orders""")
def stable_choice(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", H.stable_choice(F.array(*map(F.lit, ("calm", "storm", "fog"))), F.concat(F.lit("w"), "o_orderkey")).alias("choice"))


@query(f"SELECT doc_id, lower({_squeeze('text')}) AS norm FROM documents")
def similarity_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.similarity_text("text").alias("norm"))


@query(f"SELECT doc_id, {_words('text')}::BIGINT AS n_words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))::BIGINT AS n_unicode_words FROM documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.word_count("text").cast("long").alias("n_words"), T.unicode_word_count("text").cast("long").alias("n_unicode_words"))


@query(
    f"""WITH d AS (SELECT doc_id, text || chr(160) || 'a ﬁne' || chr(10) || '  ' || chr(10) || chr(10) || 'end  ' AS text FROM documents)
    SELECT doc_id, {_strip("regexp_replace(regexp_replace(translate(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(160) || chr(8203), '  '), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*\\n\\s*', chr(10) || chr(10), 'g')")} AS text FROM d"""
)
def rules_whitespace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.normalize_whitespace(F.concat("text", F.lit("\u00a0a ﬁne\n  \n\nend  "))).alias("text"))


_PLATFORM = "blogspot|reddit|fandom|wikipedia|dandwiki|homebrewery|github|notion|medium|stackexchange|srd"


@query(
    f"""WITH d AS ({NOISY_SQL}), a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' [a link](http://x.y) on reddit, ok', '(?i)\\b(?:https?://|www\\.)\\S+', '', 'g'), '(?i)\\b(?:{_PLATFORM})\\b', '', 'g'), '[\\t ]+', ' ', 'g') AS x FROM d)
    SELECT doc_id, {_strip("array_to_string(list_filter(string_split(x, chr(10)), lambda l: NOT " + _boiler('l') + "), chr(10))")} AS text FROM a"""
)
def transcript_normalized(t: Tables) -> DataFrame:
    x = F.concat("text", F.lit(" [a link](http://x.y) on reddit, ok"))
    x = T.sub(T.sub(T.sub(x, r"(?i)\b(?:https?://|www\.)\S+", ""), rf"(?i)\b(?:{_PLATFORM})\b", ""), r"[\t ]+", " ")
    return noisy(t).select("doc_id", T.strip(T.join_lines(F.filter(T.lines(x), lambda s: ~T.has_boilerplate(s)))).alias("text"))


@query(
    f"""SELECT doc_id, {_strip("regexp_replace(regexp_replace(regexp_replace(text || chr(10) || 'Created with Homebrewery' || chr(10) || 'a-' || chr(10) || 'b', '(?m)^.*(?:Homebrewery|GM Binder).*$', '', 'g'), '-\\n', '', 'g'), '\\n{2,}', chr(10), 'g')")} AS text FROM documents"""
)
def legacy_clean(t: Tables) -> DataFrame:
    x = T.sub(F.concat("text", F.lit("\nCreated with Homebrewery\na-\nb")), r"(?m)^.*(?:Homebrewery|GM Binder).*$", "")
    return t.documents.select("doc_id", T.strip(T.sub(T.sub(x, "-\n", ""), r"\n{2,}", "\n")).alias("text"))


@query(
    """WITH d AS (SELECT doc_id, 'x *** START OF BOOK ***' || text || ' [note 1] *** END OF BOOK *** y' AS t FROM documents),
    b AS (SELECT doc_id, regexp_extract(t, '(?s)\\*\\*\\* START OF BOOK \\*\\*\\*(.*?)\\*\\*\\* END OF BOOK \\*\\*\\*', 1) AS t FROM d)
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '\\[[^\\]]*\\]', '', 'g'), '[^\\x00-\\x7F]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM b"""
)
def book_clean(t: Tables) -> DataFrame:
    full = F.concat(F.lit("x *** START OF BOOK ***"), "text", F.lit(" [note 1] *** END OF BOOK *** y"))
    body = F.regexp_extract(full, r"(?s)\*\*\* START OF BOOK \*\*\*(.*?)\*\*\* END OF BOOK \*\*\*", 1)
    return t.documents.select("doc_id", F.trim(T.sub(T.sub(T.sub(F.lower(body), r"\[[^\]]*\]", ""), r"[^\x00-\x7F]", " "), " +", " ")).alias("text"))


@query(
    f"""WITH d AS ({NOISY_SQL}), a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' [t](u) via github', '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?i)\\b(?:https?://|www\\.)\\S+', '', 'g'), '(?i)\\b(?:{_PLATFORM})\\b', '', 'g'), '(?i)\\b[a-z]:\\\\\\S+', '', 'g') AS x FROM d)
    SELECT doc_id, {_strip("regexp_replace(regexp_replace(x, '[ \\t]{2,}', ' ', 'g'), ' +([.,;:!?])', '\\1', 'g')")} AS text FROM a"""
)
def context_redaction(t: Tables) -> DataFrame:
    return noisy(t).select("doc_id", T.redact_context(F.concat("text", F.lit(" [t](u) via github"))).alias("text"))


@query(
    f"""WITH s AS (SELECT doc_id, string_split(regexp_replace({_squeeze('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1] AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(regexp_replace(substr(s, 1, 60), ' [^ ]*\\z', '')) || '…' END AS summary FROM s"""
)
def first_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.first_sentence("text", 60).alias("summary"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_name || ', hill and wood, lake', ',| and '), lambda x: trim(x)), lambda x: x <> '')[1:3], '|') AS features FROM part")
def terrain_features(t: Tables) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.concat("p_name", F.lit(", hill and wood, lake")), ",| and "), lambda x: F.trim(x)), lambda x: x != "")
    return t.part.select("p_partkey", F.array_join(F.slice(parts, 1, 3), "|").alias("features"))


@query("""WITH n AS (SELECT c_custkey, trim(regexp_replace('  ' || c_name || CASE c_custkey % 3 WHEN 0 THEN ' Éa' ELSE '' END, '\\s+', ' ', 'g')) AS name FROM customer)
    SELECT c_custkey, name, regexp_matches(regexp_replace(name, '[#0-9]', '', 'g'), '\\A[A-ZÀ-Þ][A-Za-zÀ-ÿ'' -]{1,40}\\z') AS is_name FROM n""")
def name_clean(t: Tables) -> DataFrame:
    name = T.squeeze(F.concat(F.lit("  "), "c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit(" Éa")).otherwise(F.lit(""))))
    return t.customer.select("c_custkey", name.alias("name"), T.sub(name, "[#0-9]", "").rlike(r"\A[A-ZÀ-Þ][A-Za-zÀ-ÿ' -]{1,40}\z").alias("is_name"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(lower(p_name) || ' & grim; dark and old', '[;,•]| and | & '), lambda x: trim(x)), lambda x: x <> ''), ',') AS parts FROM part")
def list_split(t: Tables) -> DataFrame:
    parts = F.transform(F.split(F.concat(F.lower("p_name"), F.lit(" & grim; dark and old")), "[;,•]| and | & "), lambda x: F.trim(x))
    return t.part.select("p_partkey", F.array_join(F.filter(parts, lambda x: x != ""), ",").alias("parts"))


@query("SELECT n_nationkey, upper(substr(lower(replace(n_name, '_', ' ')), 1, 1)) || substr(lower(replace(n_name, '_', ' ')), 2) AS label FROM nation")
def display_names(t: Tables) -> DataFrame:
    low = F.lower(F.translate("n_name", "_", " "))
    return t.nation.select("n_nationkey", F.concat(F.upper(F.substring(low, 1, 1)), F.expr("substr(lower(translate(n_name, '_', ' ')), 2)")).alias("label"))


@query(f"""WITH d AS (SELECT doc_id, unnest({_lines("text || chr(10) || 'Page 12' || chr(10) || '- 3 -' || chr(10) || '7' || chr(10) || 'p. 9'")}) AS line, generate_subscripts({_lines("text || repeat(chr(10), 4)")}, 1) AS pos FROM documents)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM d WHERE NOT regexp_matches({_strip('line')}, '\\A(?:(?i:page\\s+)?\\d+|- ?\\d+ ?-)\\z') GROUP BY doc_id""")
def page_numbers_removed(t: Tables) -> DataFrame:
    ls = T.lines(F.concat("text", F.lit("\nPage 12\n- 3 -\n7\np. 9")))
    return t.documents.select("doc_id", T.join_lines(F.filter(ls, lambda s: ~T.strip(s).rlike(r"\A(?:(?i:page\s+)?\d+|- ?\d+ ?-)\z"))).alias("text"))


@query("SELECT item_id, sha256('{\"corpus\":\"world\",\"k\":5,\"text\":\"' || lower(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))) || '\"}') AS key FROM benchmark")
def query_cache_key(t: Tables) -> DataFrame:
    text = F.lower(F.trim(T.sub(T.sub("text", "[^A-Za-z0-9 ]", ""), r"\s+", " ")))
    return t.benchmark.select("item_id", F.sha2(F.to_json(F.struct(F.lit("world").alias("corpus"), F.lit(5).alias("k"), text.alias("text"))), 256).alias("key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'url:/o/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'index:' || o_custkey ELSE 'name:' || o_orderpriority END AS key FROM orders")
def object_keys(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    url, index = F.when(k == 0, F.concat(F.lit("/o/"), "o_orderkey")), F.when(k == 1, F.col("o_custkey"))
    return t.orders.select("o_orderkey", F.coalesce(F.concat(F.lit("url:"), url), F.concat(F.lit("index:"), index), F.concat(F.lit("name:"), "o_orderpriority")).alias("key"))
