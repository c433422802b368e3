"""Retrieval queries: documents stand for files (source: repository), benchmark items for completion points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import bm25, codeast, pack, resolve, retrieve, split
from quillspan.plans.registry import query, spread, table

TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z_][\p{L}\p{N}_]*')"
ALNUM = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', ' ', 'g'), ' +'), lambda x: x <> '')"


def _bm25(tok: str, qtok: str, idf: str) -> str:
    return f"""WITH t AS (SELECT doc_id, {tok} AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), idf0 AS (SELECT term, df, n, avgdl, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, stats),
idf AS (SELECT term, avgdl, {idf} AS idf FROM idf0), q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({qtok}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY ALL)
"""


PLAIN_IDF = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)"
PATCHED_IDF = "CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER () ELSE raw END"


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _texts(spark, sf_dir: str) -> DataFrame:
    return spread(_docs(spark, sf_dir).select("doc_id", "source", "text"))


def _scored(spark, sf_dir: str, tokens, query_tokens, **options) -> DataFrame:
    return bm25.scores(_texts(spark, sf_dir), "doc_id", tokens("text"), table(spark, sf_dir, "benchmark"), "item_id", query_tokens, **options)


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL) GROUP BY ALL")
def tokenize_df(spark, sf_dir):
    tf = bm25.term_counts(_texts(spark, sf_dir), "doc_id", T.code_tokens("text"))
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


@query(f"SELECT doc_id, len({ALNUM})::BIGINT AS n_tokens, array_to_string(list_sort(list_distinct({ALNUM})), ' ') AS vocabulary FROM documents")
def tokenize_alnum(spark, sf_dir):
    words = T.alnum_tokens("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("vocabulary"))


@query(_bm25(TOK, TOK, PLAIN_IDF) + "SELECT item_id, doc_id, rank::INTEGER AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM s WHERE score > 0) WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    top = bm25.top_k(_scored(spark, sf_dir, T.code_tokens, T.code_tokens("text")), "item_id", "doc_id", 5, digits=6)
    return top.select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(_bm25(ALNUM, ALNUM, PATCHED_IDF) + "SELECT item_id, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank = 1")
def bm25_okapi_best(spark, sf_dir):
    """The best document of each item, the first of equals."""
    s = _scored(spark, sf_dir, T.alnum_tokens, T.alnum_tokens("text"), patched=True)
    best = F.max(F.struct(F.round("score", 6).alias("r"), (-F.col("doc_id")).alias("d"), "score")).alias("b")
    return s.groupBy("item_id").agg(best).select("item_id", (-F.col("b.d")).alias("doc_id"), F.round("b.score", 4).alias("score"))


# half of an item's text stands before the cursor, half after it
_HALVES = "SELECT item_id, substr(text, 1, length(text) // 2) AS p, substr(text, length(text) // 2 + 1) AS s FROM benchmark"
_NEAR = r"regexp_extract_all(lower(right(p, 500) || ' ' || left(s, 500)), '[a-zA-Z_][\p{L}\p{N}_]*')"
_FAR = r"regexp_extract_all(lower(left(p, greatest(length(p) - 500, 0)::BIGINT)), '[a-zA-Z_][\p{L}\p{N}_]*')"


def _cursor_halves(spark, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    half = F.expr("length(text) div 2")
    return b.select("item_id", F.substring("text", F.lit(1), half).alias("p"), F.expr("substring(text, length(text) div 2 + 1)").alias("s"))


@query(
    _bm25(TOK, TOK, PLAIN_IDF).replace(f"unnest({TOK}) AS term FROM benchmark", f"unnest(list_concat({_NEAR}, {_NEAR}, {_NEAR}, {_FAR})) AS term FROM ({_HALVES})")
    + "SELECT item_id, doc_id, rank::INTEGER AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM s WHERE score > 0) WHERE rank <= 3"
)
def bm25_cursor_weighted(spark, sf_dir):
    s = bm25.scores(_texts(spark, sf_dir), "doc_id", T.code_tokens("text"), _cursor_halves(spark, sf_dir), "item_id", T.cursor_query("p", "s"))
    return bm25.top_k(s, "item_id", "doc_id", 3, digits=6).select("item_id", "doc_id", "rank", F.round("score", 4).alias("score"))


CHUNKS = "chunks AS (SELECT doc_id * 4294967296 + k - 1 AS doc_id, lines[k] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents) WHERE length(lines[k]) >= 30)"


@query(
    "WITH " + CHUNKS + ", " + _bm25(TOK, TOK, PLAIN_IDF).replace("FROM documents", "FROM chunks").removeprefix("WITH ")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM s WHERE score > 0) SELECT item_id, doc_id AS chunk, rank::INTEGER AS rank, round(score, 4) AS score FROM r WHERE rank <= 30"
)
def bm25_chunks(spark, sf_dir):
    """Lines of at least 30 characters as chunks; the 3k best for k = 10, ties to the largest chunk."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).where(F.length("text") >= 30)
    chunks = lines.select((F.col("doc_id") * (1 << 32) + F.col("k")).alias("chunk"), "text")
    s = bm25.scores(chunks, "chunk", T.code_tokens("text"), table(spark, sf_dir, "benchmark"), "item_id", T.code_tokens("text"))
    return bm25.top_k(s, "item_id", "chunk", 30, digits=6).select("item_id", "chunk", "rank", F.round("score", 4).alias("score"))


@query(rf"WITH q AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(text, '[a-zA-Z_][\p{{L}}\p{{N}}_]*')), lambda x: NOT list_contains(['self', 'cls', 'None', 'True', 'False'], x) AND length(x) > 2) AS syms FROM benchmark) SELECT item_id, doc_id, len(list_filter(syms, lambda x: contains(text, x)))::BIGINT AS hits FROM q JOIN documents ON source = 'src' || (item_id % 20)")
def cursor_hits(spark, sf_dir):
    """How many distinct symbols of an item are substrings of a file of its repository."""
    b = table(spark, sf_dir, "benchmark")
    syms = F.filter(F.array_except(F.array_distinct(T.symbol_tokens("text")), F.array(*map(F.lit, sorted(retrieve.STOP)))), lambda x: F.length(x) > 2)
    q = b.select("item_id", syms.alias("syms"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    rows = _docs(spark, sf_dir).join(q, "source")
    return rows.select("item_id", "doc_id", F.size(F.filter("syms", lambda x: F.contains("text", x))).cast("long").alias("hits"))


def _entries(spark, sf_dir: str) -> DataFrame:
    """Files as pack entries: the repository, an order, the size with its header."""
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    return _docs(spark, sf_dir).select("source", "doc_id", path.alias("path"), "text", (F.lit(13) + F.length(path) + F.length("text")).cast("long").alias("size"))


ENTRIES = "e AS (SELECT source, doc_id, 'd/' || doc_id AS path, text, 13 + length('d/' || doc_id) + length(text) AS size FROM documents)"


@query(f"WITH {ENTRIES} SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM e) WHERE used <= 24700")
def pack_prefix(spark, sf_dir):
    return pack.pack_prefix(_entries(spark, sf_dir), ["source"], ["doc_id"], "size", pack.budget_chars(6500)).select("source", "doc_id", "used")


PACKED = f"""WITH RECURSIVE {ENTRIES}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM e),
f AS (SELECT source, rn, doc_id, path, text, CASE WHEN size <= 28500 THEN size ELSE 0 END AS used, size <= 28500 AS kept FROM o WHERE rn = 1
UNION ALL SELECT o.source, o.rn, o.doc_id, o.path, o.text, CASE WHEN f.used + o.size <= 28500 THEN f.used + o.size ELSE f.used END, f.used + o.size <= 28500 FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1)
"""


@query(PACKED + "SELECT source, doc_id FROM f WHERE kept")
def pack_skip(spark, sf_dir):
    return pack.pack_skip(_entries(spark, sf_dir), ["source"], ["doc_id"], ["doc_id"], "size", pack.budget_chars(7500)).select("source", "doc_id")


@query(PACKED + "SELECT source, string_agg('<|file_sep|>' || path || chr(10) || text, '' ORDER BY doc_id) AS context FROM f WHERE kept GROUP BY ALL")
def compose_context(spark, sf_dir):
    kept = pack.pack_skip(_entries(spark, sf_dir), ["source"], ["doc_id"], ["path", "text"], "size", pack.budget_chars(7500))
    return pack.compose(kept.withColumn("piece", T.snippet("path", "text")), ["source"], ["doc_id"], "piece")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id, array_to_string(x[greatest(len(x) - 1, 1):], chr(10)) AS prefix, array_to_string(x[:2], chr(10)) AS suffix FROM l")
def trim_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.last_lines("text", 2).alias("prefix"), T.first_lines("text", 2).alias("suffix"))


@query("SELECT p_partkey, 0::INTEGER AS line_no, '' AS module, 2::INTEGER AS level, 'x' || p_size || ',y' AS names FROM part UNION ALL SELECT p_partkey, 1, 'a.m' || p_size, 0, '' FROM part UNION ALL SELECT p_partkey, 1, 'os', 0, '' FROM part")
def import_regex(spark, sf_dir):
    """Import lines made of part rows."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("from .. import x"), size, F.lit(" as z, y\nimport a.m"), size, F.lit(" as m, os\nx = 1"))
    found = T.import_lines(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")
    return found.select("p_partkey", "line_no", "module", "level", F.array_join("names", ",").alias("names"))


def _repository(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files `lib/m<size>/p<key>.py` made of parts, and modules that name them in full or by their end."""
    p = table(spark, sf_dir, "part")
    stem = F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"))
    files = p.select(F.col("p_brand").alias("repo"), F.concat(F.lit("lib/"), stem, F.lit(".py")).alias("path"), F.col("p_partkey").alias("ord"))
    module = F.concat(F.when(F.col("p_partkey") % 2 == 0, "lib.").otherwise(""), F.translate(stem, "/", "."))
    asked = p.select(F.col("p_brand").alias("repo"), "p_partkey", resolve.candidate_paths(module, F.lit(0), F.lit("lib/a.py")).alias("candidates"))
    return files, asked


_FILES = "f AS (SELECT p_brand AS repo, p_partkey AS ord, 'lib/m' || p_size || '/p' || p_partkey || '.py' AS path FROM part), a AS (SELECT p_brand AS repo, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'lib/' ELSE '' END || 'm' || p_size || '/p' || p_partkey || '.py' AS cand FROM part)"


@query(f"WITH {_FILES} SELECT a.repo, p_partkey, path FROM a JOIN f ON a.repo = f.repo AND cand = path")
def resolve_exact(spark, sf_dir):
    files, asked = _repository(spark, sf_dir)
    return resolve.resolve(asked, files, ["repo"], ["p_partkey"]).where("how = 'exact'").select("repo", "p_partkey", "path")


@query(f"WITH {_FILES} SELECT a.repo, p_partkey, min_by(path, ord) AS path FROM a JOIN f ON a.repo = f.repo AND ends_with(path, cand) WHERE p_partkey % 2 = 1 GROUP BY ALL")
def resolve_suffix(spark, sf_dir):
    files, asked = _repository(spark, sf_dir)
    return resolve.resolve(asked, files, ["repo"], ["p_partkey"]).where("how = 'suffix'").select("repo", "p_partkey", "path")


@query("WITH n AS (SELECT item_id, 'src' || (item_id % 20) AS source, regexp_extract(text, '[a-zA-Z]+') AS name FROM benchmark) SELECT item_id, doc_id FROM n JOIN documents d ON d.source = n.source AND contains(d.text, ' ' || name)")
def contains_join(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), F.regexp_extract("text", "[a-zA-Z]+", 0).alias("name"))
    return resolve.containing(names, _docs(spark, sf_dir), ["source"], "name", "text", before=" ").select("item_id", "doc_id")


@query("SELECT source, min_by(doc_id, md5('42/' || doc_id)) AS doc_id FROM documents GROUP BY ALL")
def random_file(spark, sf_dir):
    return split.pick(_docs(spark, sf_dir), "source", "doc_id")


@query("SELECT doc_id, (('0x' || substr(md5('42/' || doc_id), 1, 8))::UBIGINT < 429496729) AS is_val FROM documents")
def row_split(spark, sf_dir):
    return split.row_split(_docs(spark, sf_dir).select("doc_id"), "doc_id")


@query(PACKED + """, c AS (SELECT source, string_agg('<|file_sep|>' || path || chr(10) || text, '' ORDER BY doc_id) AS context FROM f WHERE kept GROUP BY ALL)
SELECT count(*) AS n, CAST(sum(length(context)) AS BIGINT) AS chars, round(sum(length(context)) / 3.8::DOUBLE, 3) AS tokens FROM c""")
def context_totals(spark, sf_dir):
    """Number, characters and estimated tokens of the packed contexts."""
    return pack.context_summary(compose_context(spark, sf_dir)).withColumn("tokens", F.round("tokens", 3))


@query("""WITH w AS (SELECT source, min(doc_id) AS first, lower(regexp_extract(text, '[a-zA-Z]+')) AS word FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
SELECT source, word, first, row_number() OVER (PARTITION BY source ORDER BY first, word)::INTEGER AS rank FROM w""")
def first_words(spark, sf_dir):
    """The distinct first words of a source's documents in the order of their first place."""
    rows = _docs(spark, sf_dir).where("source is not null and text is not null").select("source", "doc_id", F.lower(F.regexp_extract("text", "[a-zA-Z]+", 0)).alias("word"))
    return resolve.first_seen(rows, ["source"], "word", "doc_id").select("source", "word", "first", "rank")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


def sources(spark, sf_dir: str) -> DataFrame:
    """Python text made of whole documents: an import, a class with a method, a function and a value, named by doc_id; the class's docstring holds the document's words."""
    i = F.col("doc_id").cast("string")
    word = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " ")
    code = F.concat(
        F.lit("import os\nfrom ..pkg import helper"), i, F.lit("\n\nclass C"), i, F.lit("(Base"), i, F.lit('):\n    """'), word, F.lit('"""\n    def run(self, x: Kind'), i, F.lit("):\n        return os.path.join(x, helper"), i,
        F.lit(")\n\ndef f"), i, F.lit("(a, b=1):\n    return a\n\nVALUE = "), i, F.lit("\n"),
    )
    return _texts(spark, sf_dir).select("doc_id", "source", code.alias("code"))


def _facts(spark, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("doc_id", codeast.analyse("code").alias("f"))


@query("SELECT doc_id, 'os' AS module, '' AS names, 0::INTEGER AS level FROM documents UNION ALL SELECT doc_id, 'pkg', 'helper' || doc_id, 2 FROM documents")
def ast_imports(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", F.explode("f.imports").alias("i")).select("doc_id", "i.module", F.array_join("i.names", ",").alias("names"), "i.level")


@query("""SELECT doc_id, 'C' || doc_id AS name, 'class' AS kind, 3::INTEGER AS start, 7::INTEGER AS "end" FROM documents UNION ALL SELECT doc_id, 'run', 'method', 5, 7 FROM documents
UNION ALL SELECT doc_id, 'f' || doc_id, 'function', 8, 10 FROM documents UNION ALL SELECT doc_id, 'VALUE', 'assignment', 11, 12 FROM documents""")
def ast_definitions(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", F.explode("f.definitions").alias("d")).select("doc_id", "d.name", "d.kind", "d.start", "d.end")


@query("""SELECT doc_id, array_to_string(['import os', '', 'from ..pkg import helper' || doc_id, '', 'class C' || doc_id || '(Base' || doc_id || '):', '    def run(self, x: Kind' || doc_id || '):', '        ...', '', 'def f' || doc_id || '(a, b=1):', '    ...', '', 'VALUE = ' || doc_id, ''], chr(10)) AS skeleton FROM documents""")
def ast_skeleton(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", "f.skeleton")


@query("""SELECT doc_id, array_to_string(['import os', 'from ..pkg import helper' || doc_id, '', 'class C' || doc_id || '(Base' || doc_id || '):', '    def run(self, x: Kind' || doc_id || '):', '        return os.path.join(x, helper' || doc_id || ')', '', 'def f' || doc_id || '(a, b=1):', '    return a', '', 'VALUE = ' || doc_id], chr(10)) AS stripped FROM documents""")
def ast_docstrings(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", "f.stripped")


@query("""SELECT doc_id, 'Base' || doc_id AS bases, 'Kind' || doc_id AS hints, 'def f' || doc_id || '(a, b=1):' || chr(10) || '    return a' || chr(10) || chr(10) || 'VALUE = ' || doc_id AS snippets FROM documents""")
def ast_snippets(spark, sf_dir):
    """Base classes, type hints and the definitions of two names asked for (a third isn't there)."""
    i = F.col("doc_id").cast("string")
    code = sources(spark, sf_dir).select("doc_id", "code", codeast.analyse("code").alias("f"))
    found = codeast.snippets_of("code", F.array(F.lit("VALUE"), F.concat(F.lit("f"), i), F.lit("missing")))
    return code.select("doc_id", F.array_join("f.bases", ",").alias("bases"), F.array_join("f.hints", ",").alias("hints"), found.alias("snippets"))


@query("""SELECT doc_id, 'C' || doc_id AS name, 'class' AS kind, length(concat('class C', doc_id, '(Base', doc_id, '):', chr(10), '    \"\"\"', w, '\"\"\"', chr(10), '    def run(self, x: Kind', doc_id, '):', chr(10), '        return os.path.join(x, helper', doc_id, ')'))::INTEGER AS n_chars
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g') AS w FROM documents)
UNION ALL SELECT doc_id, 'run', 'method', length(concat('    def run(self, x: Kind', doc_id, '):', chr(10), '        return os.path.join(x, helper', doc_id, ')')) FROM documents
UNION ALL SELECT doc_id, 'f' || doc_id, 'function', length(concat('def f', doc_id, '(a, b=1):', chr(10), '    return a')) FROM documents WHERE length(doc_id::VARCHAR) >= 3""")
def ast_chunks(spark, sf_dir):
    """Definitions of at least 30 characters as chunks of their files; those of the packages' own files are left out."""
    path = F.concat(F.lit("pkg/m"), F.col("doc_id").cast("string"), F.lit(".py"))
    found = sources(spark, sf_dir).select("doc_id", F.explode(codeast.chunks_of(path, "code")).alias("c"))
    return found.select("doc_id", "c.name", "c.kind", F.length("c.text").alias("n_chars"))


def _points(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = sources(spark, sf_dir).select(F.col("source").alias("repo"), F.lit("r1").alias("revision"), F.concat(F.lit("pkg/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("code").alias("content"))
    i = F.col("item_id").cast("string")
    prefix = F.concat(F.lit("from pkg import m"), i, F.lit("\n\nclass Mine(C"), i, F.lit("):\n    def go(self, x: Kind"), i, F.lit("):\n        return f"), i, F.lit("(x"))
    points = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("point_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"), F.lit("r1").alias("revision"), F.lit("main.py").alias("path"),
        prefix.alias("prefix"), F.concat(F.lit(")\n# "), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " "), F.lit("\n")).alias("suffix"), F.array(F.concat(F.lit("pkg/m"), i, F.lit(".py"))).alias("modified"),
    )
    return points, files


def _retrieved(variant: str):
    def run(spark, sf_dir):
        points, files = _points(spark, sf_dir)
        return retrieve.contexts(points, files, variant)

    run.__name__ = f"retrieve_{variant}"
    return query()(run)


retrieve_v1, retrieve_v2, retrieve_v5 = map(_retrieved, ("v1", "v2", "v5"))
