"""Queries of the corpus operators and, where SQL can express them, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm.distinctive import distinctive_terms
from reviewloom.llm.encode import encode_documents
from reviewloom.llm.frequency import mark_terms, merge_runs, term_frequencies
from reviewloom.llm.markup import clean_markup
from reviewloom.llm.near_duplicates import duplicate_groups, record_copies, similar_links, similar_pairs
from reviewloom.llm.packing import pack_documents
from reviewloom.llm.shared_spans import document_copies, repeated_units, shared_characters, shared_spans, span_pairs, without_repeats
from reviewloom.llm.top_items import top_items
from reviewloom.operators.reviews import current_reviews
from reviewloom.session import stash
from reviewloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_R = "r AS (SELECT DISTINCT ON (review_id) * FROM reviews ORDER BY review_id, loaded_at)"
_POST = _R + ", post AS (SELECT token, review_id, count(*) AS tf FROM (SELECT review_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS token FROM r) GROUP BY ALL), stats AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1)"


_PAIRS = (
    f"{_R}, t AS (SELECT review_id, list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x)) AS l FROM r),"
    " s AS (SELECT DISTINCT review_id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS g FROM t WHERE len(l) >= 25),"
    " f AS (SELECT g, count(*) AS f FROM s GROUP BY 1),"
    " o AS (SELECT review_id, g, row_number() OVER (PARTITION BY review_id ORDER BY f, g) AS k, count(*) OVER (PARTITION BY review_id) AS n FROM s JOIN f USING (g)),"
    # two sets with a similarity of a half share one of their rarest half of runs
    " p AS (SELECT review_id, g FROM o WHERE k <= n - ceil(n / 2.0) + 1),"
    " c AS (SELECT DISTINCT a.review_id AS a, b.review_id AS b FROM p a JOIN p b ON a.g = b.g AND a.review_id < b.review_id),"
    " m AS (SELECT a, b, count(*) AS shared FROM c JOIN s x ON x.review_id = a JOIN s y ON y.review_id = b AND y.g = x.g GROUP BY ALL),"
    " n AS (SELECT review_id, count(*) AS n FROM s GROUP BY 1),"
    " pairs AS (SELECT a, b, shared = x.n AND shared = y.n AS same FROM m JOIN n x ON x.review_id = a JOIN n y ON y.review_id = b WHERE shared * 2 >= x.n + y.n - shared)"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p1_found(s, d):
    return clean_markup(table(s, d, "documents")).select("doc_id", F.explode("families").alias("family"))


@query()
def p1_clean(s, d):
    """Clean text, and its blocks as `kind<level>: text` lines."""
    c = clean_markup(table(s, d, "documents"))
    return c.select("doc_id", "text", F.transform("blocks", lambda b: F.concat(b["kind"], b["level"].cast("string"), F.lit(": "), b["text"])).alias("blocks"))


def _texts(s, d) -> DataFrame:
    return current_reviews(table(s, d, "reviews"), "text")


@query(f"WITH {_POST} SELECT review_id, token FROM post JOIN stats USING (token) WHERE tf >= 3 AND df BETWEEN 2 AND 5")
def p2_found(s, d):
    return distinctive_terms(_texts(s, d)).filter("tf >= 3 and df between 2 and 5").select("review_id", "token")


@query(
    f"WITH {_POST}, w AS (SELECT review_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS token, generate_subscripts(regexp_extract_all(text, '[a-zA-Z0-9]+'), 1) AS i FROM r),"
    " e AS (SELECT a.review_id, a.token AS x, b.token AS y FROM w a JOIN w b ON a.review_id = b.review_id AND b.i IN (a.i + 1, a.i + 2, a.i + 3) WHERE a.token <> b.token),"
    " g AS (SELECT review_id, token, count(DISTINCT n) AS degree FROM (SELECT review_id, x AS token, y AS n FROM e UNION ALL SELECT review_id, y, x FROM e) GROUP BY ALL)"
    " SELECT review_id, token, tf, coalesce(degree, 0) AS degree, df, round(coalesce(degree, 0) * ln(((SELECT count(*) FROM r) + 1) / CAST(df AS DOUBLE)), 6) AS score"
    " FROM post JOIN stats USING (token) LEFT JOIN g USING (review_id, token)"
)
def p2_scores(s, d):
    """Every token of every review with its score."""
    return distinctive_terms(_texts(s, d)).withColumn("score", F.round("score", 6))


_ORDER = "coalesce(score, 0) DESC, CASE WHEN helpfulness_denom > 0 THEN coalesce(CAST(helpfulness_num AS DOUBLE) / helpfulness_denom, 0) ELSE 0 END DESC, coalesce(helpfulness_denom, 0) DESC, review_id"


@query(
    f"WITH {_R}, k AS (SELECT product_id, review_id, row_number() OVER (PARTITION BY product_id ORDER BY {_ORDER}) AS n FROM r WHERE product_id IS NOT NULL) SELECT product_id, review_id FROM k WHERE n <= 3"
)
def p5_found(s, d):
    den = F.col("helpfulness_denom")
    order = [
        F.coalesce("score", F.lit(0)),
        F.when(den > 0, F.coalesce(F.col("helpfulness_num").cast("double") / den, F.lit(0.0))).otherwise(0.0),
        F.coalesce(den, F.lit(0)),
    ]
    r = table(s, d, "reviews").filter("product_id is not null and review_id is not null")
    return top_items(r, ["product_id"], order, "review_id", 3).select("product_id", "review_id")


@query(f"WITH {_POST}, m AS (SELECT token, CASE WHEN df <= 2 THEN 'rare' WHEN df * 10 > (SELECT count(*) FROM r) THEN 'common' END AS mark FROM stats) SELECT token, mark FROM m WHERE mark IS NOT NULL")
def p7_found(s, d):
    n = table(s, d, "reviews").select("review_id").distinct().agg(F.count("review_id").alias("n")).scalar()
    return mark_terms(term_frequencies(_texts(s, d)), n).filter("mark is not null").select("token", "mark")


@query(f"WITH {_POST} SELECT token, df, cf, CASE WHEN df <= 2 THEN 'rare' WHEN df * 10 > (SELECT count(*) FROM r) THEN 'common' END AS mark FROM stats")
def p7_frequencies(s, d):
    n = table(s, d, "reviews").select("review_id").distinct().agg(F.count("review_id").alias("n")).scalar()
    return mark_terms(term_frequencies(_texts(s, d)), n)


@query("SELECT token, CAST(sum(df) AS BIGINT) AS df, CAST(sum(cf) AS BIGINT) AS cf FROM (SELECT DISTINCT segment, token, df, cf FROM tokens) WHERE token IS NOT NULL GROUP BY 1")
def p7_segments(s, d):
    """The dictionaries of all index segments merged; segments hold different reviews, so their counts add up."""
    return merge_runs(table(s, d, "tokens").select("segment", "token", "df", "cf").distinct().select("token", "df", "cf"))


@query()
def p8_ids(s, d):
    return encode_documents(table(s, d, "documents"))


@query(f"WITH {_PAIRS} SELECT a AS review_a, b AS review_b FROM pairs")
def p6_found(s, d):
    pairs = similar_pairs(*similar_links(table(s, d, "reviews")))
    return pairs.select(F.col("a").alias("review_a"), F.col("b").alias("review_b"))


@query(
    f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b, same FROM pairs UNION ALL SELECT b, a, same FROM pairs),"
    " reach AS (SELECT DISTINCT a AS id, a AS node FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.node),"
    ' grp AS (SELECT id, min(node) AS "group" FROM reach GROUP BY 1),'
    " rep AS (SELECT a AS id, least(a, coalesce(min(b) FILTER (same), a)) AS rep FROM e GROUP BY a),"
    " links AS (SELECT x.rep, count(DISTINCT y.rep) AS n_links FROM e JOIN rep x ON x.id = a JOIN rep y ON y.id = b WHERE NOT same GROUP BY 1)"
    ' SELECT id AS review_id, "group", coalesce(n_links, 0) AS n_links FROM grp JOIN rep USING (id) LEFT JOIN links USING (rep)'
)
def p6_groups(s, d):
    """Groups of reviews that repeat another with small changes: one row per review that has a copy or a link."""
    links, members = similar_links(table(s, d, "reviews"))
    return duplicate_groups(stash(links, "links"), members).withColumnRenamed("id", "review_id")


@query(
    f"WITH {_R}, t AS (SELECT review_id, text FROM r WHERE len(regexp_extract_all(text, '[a-zA-Z0-9]+')) >= 25),"
    " c AS (SELECT *, min(review_id) OVER (PARTITION BY text) AS copy_of, count(*) OVER (PARTITION BY text) AS n FROM t) SELECT review_id, copy_of FROM c WHERE n > 1"
)
def p6_copies(s, d):
    """Every review of 25 tokens or more whose exact text another has too, with the first of them: what completes p6_found
    where it links copies to their first only."""
    return record_copies(table(s, d, "reviews")).withColumnRenamed("id", "review_id")


@query(
    "WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),"
    " a AS (SELECT doc_id, unnest(range(1, n - 98, 100)) AS i, text FROM t), b AS (SELECT doc_id, unnest(range(1, n - 98)) AS j, text FROM t),"
    " x AS (SELECT doc_id AS a, i, md5(substr(text, i, 100)) AS h FROM a), y AS (SELECT doc_id AS b, j, md5(substr(text, j, 100)) AS h FROM b),"
    # a span of 200 characters holds a run of 100 that begins at a multiple of 100 in either text
    " c AS (SELECT a, i, b, j, unnest(range(0, 101)) AS o FROM x JOIN y USING (h) WHERE a <> b),"
    " m AS (SELECT DISTINCT a, b FROM c JOIN t u ON u.doc_id = a JOIN t v ON v.doc_id = b WHERE i > o AND j > o AND i - o + 199 <= u.n AND j - o + 199 <= v.n AND substr(u.text, i - o, 200) = substr(v.text, j - o, 200))"
    " SELECT DISTINCT least(a, b) AS doc_a, greatest(a, b) AS doc_b FROM m"
)
def p10_found(s, d):
    pairs = span_pairs(*shared_spans(table(s, d, "documents"), one=True))
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


@query(
    "WITH x AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) >= 200 GROUP BY text),"
    " t AS (SELECT doc_id, unnest(range(1, length(text) - 198)) AS i, text FROM x), w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM t),"
    " m AS (SELECT a.doc_id AS a, b.doc_id AS b, a.i AS i, b.i - a.i AS shift FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id),"
    " g AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, shift ORDER BY i) AS run FROM m)"
    " SELECT a AS doc_a, b AS doc_b, CAST(min(i) - 1 AS INT) AS at_a, CAST(min(i) + shift - 1 AS INT) AS at_b, CAST(count(*) + 199 AS INT) AS chars FROM g GROUP BY a, b, shift, run"
)
def p10_spans(s, d):
    """The spans themselves, between representatives of equal texts."""
    spans, _ = shared_spans(table(s, d, "documents"))
    return spans.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "at_a", "at_b", "chars")


@query(
    "WITH t AS (SELECT doc_id, unnest(range(1, length(text) - 198)) AS i, text FROM documents WHERE length(text) >= 200),"
    " w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM t),"
    " k AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),"
    " c AS (SELECT doc_id, least(200, lead(i, 1, i + 200) OVER (PARTITION BY doc_id ORDER BY i) - i) AS n FROM w SEMI JOIN k USING (h)),"
    " u AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1)"
    " SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS shared_chars FROM documents LEFT JOIN u USING (doc_id)"
)
def p10_shared(s, d):
    docs = table(s, d, "documents")
    spans, members = shared_spans(docs, every=False)
    return shared_characters(docs, stash(spans, "spans"), members)


@query("WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS copy_of, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE length(text) >= 200) SELECT doc_id, copy_of FROM c WHERE n > 1")
def p10_copies(s, d):
    """Documents with exactly the same text: what completes p10_spans, which holds their first, and p10_found beyond 64 copies."""
    return document_copies(table(s, d, "documents")).select(F.col("id").alias("doc_id"), F.col("rep").alias("copy_of"))


@query(
    "WITH u AS (SELECT doc_id, i, u, lower(trim(regexp_replace(u, '\\s+', ' ', 'g'))) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS u,"
    " generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents) WHERE trim(u) <> ''),"
    " k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(i) OVER w AS keep_i FROM u WINDOW w AS (PARTITION BY n ORDER BY doc_id, i))"
    " SELECT doc_id, u AS text, keep_id FROM k WHERE doc_id <> keep_id OR i <> keep_i"
)
def p10_paragraphs(s, d):
    """Whole paragraphs that stand before in this or another document."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return repeated_units(docs).select(F.col("id").alias("doc_id"), "text", "keep_id")


@query()
def p9_found(s, d):
    return pack_documents(table(s, d, "documents")).filter("parts > 1 and part = 0").select("doc_id")


@query()
def p9_pack(s, d):
    return pack_documents(table(s, d, "documents"))


@query("SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS overfull, true AS well_filled FROM documents HAVING count(*) > 0")
def p9_checked(s, d):
    """What must hold of the packing: every token of every document, counted by the encoder, stands in one container; no document is
    cut that fits one; no container holds more than its capacity; at least 0.97 of the room, or all but a container, is used."""
    docs = table(s, d, "documents")
    p = stash(pack_documents(docs), "packed")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = p.withColumn("before", before).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), (F.count_if((F.col("start") == F.col("before")) & (F.col("parts") > F.col("part"))) == F.max("parts")).alias("whole"), F.max("parts").alias("parts"))
    j = encode_documents(docs).select("doc_id", F.size("ids").alias("size")).join(parts, "doc_id", "full")
    ok = (F.col("size") == F.col("n")) & F.col("whole")
    of_docs = j.agg(F.count("size").alias("n_documents"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("misplaced"), F.count_if((F.col("parts") > 1) & (F.col("size") <= 2048)).alias("cut"), F.lit(1).alias("k"))
    boxes = p.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    used = F.coalesce(F.sum("n"), F.lit(0))
    of_boxes = boxes.agg(F.count_if(F.col("n") > 2048).alias("overfull"), (F.count(F.lit(1)) * 2048 * 0.97 <= used + 2048).alias("well_filled"), F.lit(1).alias("k"))
    return of_docs.join(of_boxes, "k").drop("k").filter("n_documents > 0")


@query(
    "WITH u AS (SELECT doc_id, i, u, lower(trim(regexp_replace(u, '\\s+', ' ', 'g'))) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS u,"
    " generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents)),"
    " p AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id, i) AS k, coalesce(sum(length(u) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM u),"
    " g AS (SELECT doc_id, string_agg(u, chr(10) || chr(10) ORDER BY i) AS text, string_agg(pos || '+' || length(u), ',' ORDER BY i) AS kept FROM p WHERE k = 1 OR n = '' GROUP BY 1)"
    " SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text, CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS kept FROM documents d LEFT JOIN g USING (doc_id)"
)
def p10_deduplicated(s, d):
    """Every text without the paragraphs that stand before elsewhere, and where its paragraphs stood: `offset+length,…`."""
    c = without_repeats(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    kept = F.array_join(F.transform("kept", lambda k: F.concat_ws("+", k["at"], k["chars"])), ",")
    return c.select(F.col("id").alias("doc_id"), "text", kept.alias("kept"))
