"""Queries of the engine over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex import schema
from loomdex.functions import scalars as sc
from loomdex.functions import korean, stem, text
from loomdex.operators import index, store
from loomdex.operators import search as se
from loomdex.operators import where as wh
from loomdex.plans.dialect import parse
from loomdex.plans.engine import Engine
from loomdex.plans.hooks import DECLINE, Hooks
from loomdex.session import workspace
from loomdex.sources import documents as src
from loomdex.streaming import spool

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = schema.DOCUMENTS
#: Words that analysers may drop.
STOP = ("the", "of", "and", "to", "in", "is", "der", "die", "das", "und", "le", "la", "les", "de", "que", "el")
SYNONYMS = {"the": ("der", "le")}

# ---------------------------------------------------------------- SQL building blocks
WORDS = r"'[\p{L}\p{N}]+'"
D = "d as (select doc_id, split_part(text, chr(10), 1) as title, substr(text, length(split_part(text, chr(10), 1)) + 2) as body, lang, source, n_chars, case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 when 'es' then 4 end as lang_code from documents)"
L = f"l as (select doc_id, 0 as field, regexp_extract_all(lower(title), {WORDS}) as w from d union all select doc_id, 1, regexp_extract_all(lower(body), {WORDS}) from d)"
T = f"with {D}, {L}, t as (select doc_id, field, substr(unnest(w), 1, 39) as word, unnest(range(len(w))) as pos from l)"
WEIGHT = "case when field = 0 then 2.0 else 1.0 end"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.documents(table(spark, sf_dir, "documents"))


def engine(spark: SparkSession, sf_dir: str, **options: object) -> Engine:
    return Engine(docs(spark, sf_dir), C, options=se.Options(**options) if options else None)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(docs(spark, sf_dir), C)


def searching(name: str, expression: str, words: list[str] | str, having: str, scored: list[str] | None = None, weight: str = WEIGHT, **options: object) -> None:
    """A query for a text expression; its SQL counts hits of words (a list or a condition on word) per document."""
    wanted = "word in (" + ", ".join(f"'{w}'" for w in words) + ")" if isinstance(words, list) else words
    counted = f" filter (where word in ({', '.join(repr(w) for w in scored)}))" if scored else ""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return se.search(docs(spark, sf_dir), expression, C, se.Options(**options) if options else None).select("doc_id", "relevance")

    run.__name__ = name
    query(f"{T} select doc_id, cast(sum({weight}){counted} as double) as relevance from t where {wanted} group by doc_id having {having}")(run)


searching("search_term", "the", ["the"], "true")
searching("search_and", "the & of", ["the", "of"], "bool_or(word = 'the') and bool_or(word = 'of')")
searching("search_or", "der + les", ["der", "les"], "true")
searching("search_not", "the ! of", ["the", "of"], "bool_or(word = 'the') and not bool_or(word = 'of')", ["the"])
searching("set_and", "(the of) & and", ["the", "of", "and"], "count(distinct word) = 3")
searching("set_or", "(der + die) + das", ["der", "die", "das"], "true")
searching("set_not", "(the + der) ! (and + und)", ["the", "der", "and", "und"], "bool_or(word in ('the', 'der')) and not bool_or(word in ('and', 'und'))", ["the", "der"])
searching("search_field", "title:(the + of)", "word in ('the', 'of') and field = 0", "true")
searching("search_virtual_field", "all:the", ["the"], "true")
searching("search_phrase", '"of the"', ["of", "the"], "doc_id in (select a.doc_id from t a join t b on a.doc_id = b.doc_id and a.field = b.field and b.pos = a.pos + 1 where a.word = 'of' and b.word = 'the')")
searching("search_within", "the /2/ and", ["the", "and"], "doc_id in (select a.doc_id from t a join t b on a.doc_id = b.doc_id and a.field = b.field and abs(b.pos - a.pos) between 1 and 3 where a.word = 'the' and b.word = 'and')")
searching("search_prefix", "ther*", "starts_with(word, 'ther')", "true")
searching("search_suffix", "*tion", "ends_with(word, 'tion')", "true")
searching("search_fuzzy", "tion%1", "regexp_matches(word, '^(tion|.ion|t.on|ti.n|tio.|.tion|t.ion|ti.on|tio.n|tion.|ion|ton|tin|tio)$')", "true")
searching("search_synonym", "SYN:the", ["the", "der", "le"], "true", synonyms=SYNONYMS)
searching("search_natural", "NATURAL:(thing den les)", ["thing", "den", "les"], "true")
searching("search_weighted", "the^3 + of", ["the", "of"], "true", weight=f"({WEIGHT}) * case when word = 'the' then 3.0 else 1.0 end")
_LINES = "select doc_id, unnest(string_split(title, chr(10))) as p from d union all select doc_id, unnest(string_split(body, chr(10))) from d"
searching("search_para", "PARA:(the of)", ["the", "of"], f"doc_id in (select doc_id from ({_LINES}) where list_contains(regexp_extract_all(lower(p), {WORDS}), 'the') and list_contains(regexp_extract_all(lower(p), {WORDS}), 'of'))")


@query(rf"""with {D}, {L}, b as (select doc_id, field, flatten(list_transform(w, lambda x: case when length(x) < 2 then [x] else list_transform(range(1, length(x)), lambda i: substr(x, cast(i as integer), 2)) end)) as w from l),
t as (select doc_id, field, unnest(w) as word, unnest(range(len(w))) as pos from b)
select doc_id, cast(sum({WEIGHT}) as double) as relevance from t where word in ('ti', 'io', 'on') group by doc_id
having doc_id in (select a.doc_id from t a join t b on a.doc_id = b.doc_id and a.field = b.field and b.pos = a.pos + 1 join t c on a.doc_id = c.doc_id and a.field = c.field and c.pos = a.pos + 2 where a.word = 'ti' and b.word = 'io' and c.word = 'on')""")
def search_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search(docs(spark, sf_dir), "BIGRAM:tion", C).select("doc_id", "relevance")


#: Endings of English words, to spell out what has the stem "thing".
ENDINGS = ("", "s", "ed", "ing", "ings", "er", "ers", "ly", "ness", "ful", "fulness", "ize", "ization", "al", "ally", "ous", "ously", "ive", "ation", "ate", "ates", "ement", "ment", "ent", "ence", "ance", "able", "ible", "ic", "ical", "ion", "ism", "ity", "y", "ies", "e", "es")
searching("search_stemmed", "MORP:things", [f"thing{e}" for e in ENDINGS if se.stem_word(f"thing{e}") == "thing"], "true")
searching("search_numeric", "NUMERIC:100~5000", r"regexp_full_match(word, '[0-9]{1,15}') and try_cast(word as bigint) between 100 and 5000", "true")
searching("search_related", "REL:thing", ["thing", "der", "les", "of"], "true", related={"thing": {"broader": ("der", "les"), "see": ("of", "les")}})

_BUILT: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written index of the documents, made once per application and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        path = workspace(spark, "index")
        index.write(posts(spark, sf_dir), path)
        _BUILT[key] = path
    return index.read(spark, _BUILT[key])


@query(rf"{T} select doc_id, cast(sum({WEIGHT}) as double) as relevance from t where word in ('the', 'of') group by doc_id having count(distinct word) = 2")
def search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the written index: the buckets of two words are read, and their postings grouped once."""
    return se.search(docs(spark, sf_dir).select("doc_id"), "the & of", C, postings=built(spark, sf_dir)).select("doc_id", "relevance")


@query(SQL["search_phrase"])
def phrase_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search(docs(spark, sf_dir).select("doc_id"), '"of the"', C, postings=built(spark, sf_dir)).select("doc_id", "relevance")


@query(f"{T} select doc_id, field, cast(pos as integer) as pos, word from t where word = 'thing'")
def posting_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lookup(built(spark, sf_dir), ["thing"]).select("doc_id", "field", "pos", "word")


@query(f"{T} select field, count(*) as hits, count(distinct word) as words, cast(sum(pos) as bigint) as positions from t group by field")
def index_defragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over an index that was made in two appends and then copied into one file a bucket."""
    found, loose, tight = posts(spark, sf_dir), workspace(spark, "loose"), workspace(spark, "tight")
    for i in range(2):
        index.write(found.where(F.pmod("doc_id", F.lit(2)) == i), f"{loose}/part={i}", 8, 2)
    both = spark.read.parquet(loose)
    both.drop("part").write.partitionBy("bucket").parquet(f"{loose}-all")
    index.defragment(spark, f"{loose}-all", tight)
    return index.read(spark, tight).groupBy("field").agg(F.count("*").alias("hits"), F.count_distinct("word").alias("words"), F.sum("pos").alias("positions"))


@query(f"{T} select cast(doc_id % 3 as integer) as folder, count(*) as hits, count(distinct doc_id) as docs from t group by 1")
def index_distribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings over three folders, counted in each."""
    paths = [workspace(spark, f"part{i}") for i in range(3)]
    index.distribute(posts(spark, sf_dir), paths)
    out = [spark.read.parquet(p).groupBy().agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs")).select(F.lit(i).alias("folder"), "hits", "docs") for i, p in enumerate(paths)]
    return out[0].union(out[1]).union(out[2])


@query(r"select page_id, regexp_extract(url, '^[^/]*/[^/]*/(?:www\.)?([^/]*(?:/~[^/]*)?)', 1) as site from pages where regexp_extract(url, '^[^/]*/[^/]*/(?:www\.)?([^/]*(?:/~[^/]*)?)', 1) like '%example.com'")
def search_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sc.url_to_site(F.col("url")).alias("site")).where(F.col("site").endswith("example.com"))


@query(r"""select page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) as link from pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(src.links(F.col("html"))).alias("link"))


# ---------------------------------------------------------------- statements
_TOP = "select doc_id, cast(sum(case when field = 0 then 2.0 else 1.0 end) as double) as relevance from t where word in ('the', 'of') group by doc_id having count(distinct word) = 2"
_R = f"{T}, r as ({_TOP}), a as (select r.*, d.lang, d.source, d.n_chars, d.lang_code from r join d on r.doc_id = d.doc_id)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("SELECT doc_id, source, lang, relevance SEARCH the & of ORDER_BY RELEVANCY DESC LIMIT 10")


@query(f"{_R} select doc_id, source, lang, relevance from a order by relevance desc, doc_id limit 10")
def rank_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query(f"{_R} select doc_id, lang, n_chars from a")
def select_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("SELECT doc_id, lang, n_chars SEARCH the of")


@query(f"{_R} select doc_id, source, n_chars, relevance from a order by source desc, n_chars, doc_id limit 25")
def order_by_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("SELECT doc_id, source, n_chars, relevance SEARCH the of ORDER_BY source DESC, n_chars ASC LIMIT 25")


@query(f"{_R} select doc_id, relevance from a order by relevance, doc_id limit 25")
def sort_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("SELECT doc_id, relevance SEARCH the of ORDER_BY RELEVANCY LIMIT 25")


@query(f"{_R} select doc_id, relevance from a order by relevance desc, doc_id limit 10 offset 20")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("SELECT doc_id, relevance SEARCH the of ORDER_BY RELEVANCY DESC LIMIT 20, 10")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 10 offset 20")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(docs(spark, sf_dir).select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 3)


@query(f"{_R} select count(*) as result_count, '(the & of)' as parsed_query from a")
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).count("SELECT * SEARCH the of LIMIT 3")


@query(f"{_R} select source, relevance, size from (select source, max(relevance) as relevance, count(*) as size from a group by source) order by relevance desc, source limit 5")
def virtual_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run("SELECT * SEARCH the of VIRTUAL_ID source ORDER_BY RELEVANCY DESC LIMIT 5").select("source", "relevance", "size")


_RANKED = "select *, row_number() over (partition by source order by relevance desc, doc_id) as rank from a"


@query(f"{_R} select source, rank, doc_id, relevance from ({_RANKED}) where rank <= 3")
def group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).run("SELECT * SEARCH the of VIRTUAL_ID source ( GROUP_BY source LIMIT 3 ORDER_BY RELEVANCY DESC )")
    return rows.select("source", F.explode("docs").alias("m")).select("source", "m.rank", "m.doc_id", "m.relevance")


@query(f"{_R} select source, rank, doc_id, relevance from ({_RANKED.replace('from a', 'from a where n_chars > 500')}) where rank > 2 and rank <= 7")
def group_topk_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).run("SELECT * SEARCH the of VIRTUAL_ID source ( WHERE n_chars > 500 GROUP_BY source LIMIT 2, 5 ORDER_BY RELEVANCY DESC )")
    return rows.select("source", F.explode("docs").alias("m")).select("source", "m.rank", "m.doc_id", "m.relevance")


@query(f"{_R} select lang, rank, doc_id from (select *, row_number() over (partition by lang order by doc_id) as rank from a) where rank <= 2")
def nested_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested virtual documents, flattened."""
    rows = engine(spark, sf_dir).run("SELECT * SEARCH the of VIRTUAL_ID lang ( GROUP_BY lang LIMIT 2 ) OUTPUT_STYLE NESTED")
    return rows.select("lang", F.explode("docs").alias("m")).select("lang", "m.rank", "m.doc_id")


@query(f"{_R} select source, count(*) as count from a group by source")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).facets("SELECT * SEARCH the of", "source")


@query("select 'lang' as attribute, lang as value, count(*) as count from documents group by lang union all select 'source', source, count(*) from documents group by source")
def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.facets(docs(spark, sf_dir), "lang", "source")


@query("select count(*) as n, count(distinct source) as sources from documents")
def count_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


# ---------------------------------------------------------------- conditions
def filtering(name: str, condition: str, sql: str, source: str = "documents", columns: tuple[str, ...] = ("doc_id", "n_chars"), arrays: frozenset[str] = frozenset(), prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir) if source == "documents" else table(spark, sf_dir, source)
        rows = prepare(rows) if prepare else rows
        return rows.where(wh.condition(condition, C.enums, arrays)).select(*columns)

    run.__name__ = name
    query(sql)(run)


filtering("where_compare", "n_chars >= 1000 AND n_chars <> 2000", "select doc_id, n_chars from documents where n_chars >= 1000 and n_chars <> 2000")
filtering("where_boolean", "NOT (lang = 'en' OR n_chars < 500) AND source != 'src0'", "select doc_id, n_chars from documents where not (lang = 'en' or n_chars < 500) and source <> 'src0'")
filtering("where_between", "n_chars BETWEEN 500 AND 1500 AND n_chars NOT BETWEEN 700 AND 800", "select doc_id, n_chars from documents where n_chars between 500 and 1500 and n_chars not between 700 and 800")
filtering("where_null", "q IS NULL OR n_chars IS NOT NULL AND q = 3", "select doc_id, n_chars from (select *, nullif(n_chars % 7, 0) as q from documents) where q is null or n_chars is not null and q = 3", prepare=lambda d: d.withColumn("q", F.nullif(F.col("n_chars") % 7, F.lit(0))))
filtering("where_in", "source IN ('src1', 'src2', 'src3') AND lang NOT IN ('en', 'de')", "select doc_id, n_chars from documents where source in ('src1', 'src2', 'src3') and lang not in ('en', 'de')")
filtering("where_list_in", "tags IN ('en', 'fr', 'src1', 'src2', 'src3')", "select doc_id, n_chars from documents where lang in ('en', 'fr') and source in ('src1', 'src2', 'src3')", arrays=frozenset({"tags"}), prepare=lambda d: d.withColumn("tags", F.array("lang", "source")))
filtering("where_list_common", "tags COMMON ('es', 'src5')", "select doc_id, n_chars from documents where list_has_any([lang, source], ['es', 'src5'])", arrays=frozenset({"tags"}), prepare=lambda d: d.withColumn("tags", F.array("lang", "source")))
filtering("where_arith", "n_chars * 2 - 100 > 3000 + doc_id AND -n_chars < -10 / 4", "select doc_id, n_chars from documents where n_chars * 2 - 100 > 3000 + doc_id and -n_chars < -10 / 4")
filtering("where_bitops", "n_chars & 6 | 1 = 5 AND ~n_chars < 0", "select doc_id, n_chars from documents where ((n_chars & 6) | 1) = 5 and ~n_chars < 0")
filtering("enum_filter", "lang_code IN (FR, DE)", "select doc_id, n_chars from documents where lang in ('fr', 'de')")
filtering("where_date_range", "ymd BETWEEN 19950101 AND 19951231", "select o_orderkey, cast(strftime(o_orderdate, '%Y%m%d') as integer) as ymd from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'", "orders", ("o_orderkey", "ymd"), prepare=lambda o: o.withColumn("ymd", sc.yyyymmdd(F.col("o_orderdate"))))


@query("select doc_id, lang, source from documents where lang in ('en', 'fr') and source = 'src1' and n_chars between 100 and 5000")
def legacy_attr_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(wh.legacy("lang:en,fr&source:src1&n_chars:100~5000")).select("doc_id", "lang", "source")


@query("select p_partkey, 'this' as mode from part where replace(p_type, ' ', '/') = (select min(replace(p_type, ' ', '/')) from part) union all select p_partkey, 'below' from part where starts_with(replace(p_type, ' ', '/') || '/', 'STANDARD/') union all select p_partkey, 'multi' from part where p_brand in ('Brand#11', 'Brand#12')")
def category_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("path", F.translate("p_type", " ", "/"))
    least = p.agg(F.min("path").alias("path"))
    this = p.join(F.broadcast(least), "path").select("p_partkey", F.lit("this").alias("mode"))
    below = p.where(wh.category(F.col("path"), "STANDARD", "below")).select("p_partkey", F.lit("below"))
    return this.union(below).union(p.where(wh.category(F.col("p_brand"), "Brand#11,Brand#12", "multi")).select("p_partkey", F.lit("multi")))


@query(f"{_R} select a.doc_id, a.relevance, labels.quality from a join labels on a.doc_id = labels.doc_id where labels.quality = 1")
def docattr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits joined with attributes by id, then filtered."""
    hit = engine(spark, sf_dir).run("SELECT doc_id, relevance SEARCH the of")
    return hit.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", "quality"), "doc_id")


@query("select d.doc_id, d.lang from documents d where d.doc_id not in (select doc_id from labels where toxic = 1)")
def filter_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    return store.mark_deleted(docs(spark, sf_dir).select("doc_id", "lang"), gone, "doc_id").where("not deleted").select("doc_id", "lang")


@query("select event_id, user_id from events where user_id not in (select o_custkey from orders where o_orderstatus = 'F')")
def delete_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"))
    return store.delete(table(spark, sf_dir, "events").select("event_id", "user_id"), gone, "user_id")


@query("select d.doc_id, coalesce(case when l.quality = 1 then 'GOOD' end, d.lang) as lang, d.source from documents d left join labels l on d.doc_id = l.doc_id")
def docattr_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "GOOD").alias("lang"))
    return store.update(docs(spark, sf_dir).select("doc_id", "lang", "source"), changes, "doc_id")


@query("select doc_id, length(text) as n_chars, split_part(text, chr(10), 1) as title, case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 when 'es' then 4 end as lang_code from documents")
def rebuild_docattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes derived anew from the stored texts."""
    raw = table(spark, sf_dir, "documents")
    return raw.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.substring_index("text", "\n", 1).alias("title"), schema.enum_code(F.col("lang"), C.enums).alias("lang_code"))


# ---------------------------------------------------------------- store
@query("select user_id, event_id, event_type, versions, old_version from (select user_id, event_id, event_type, count(*) over (partition by user_id) as versions, lag(event_id) over (partition by user_id order by event_id) as old_version, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def put_latest_per_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("select d.doc_id, d.lang, coalesce(l.toxic = 1 and coalesce(l.quality, 0) <> 1, false) as deleted from documents d left join labels l on d.doc_id = l.doc_id")
def undelete_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents marked as deleted, those of good quality taken back."""
    labels = table(spark, sf_dir, "labels")
    marked = store.mark_deleted(docs(spark, sf_dir).select("doc_id", "lang"), labels.where("toxic = 1"), "doc_id")
    return store.undelete(marked, labels.where("quality = 1"), "doc_id")


_RECORDS = "r as (select cast(user_id as varchar) as oid, event_id as seq, case when value < 5 then 'DEL' when value < 10 then 'ERR' else 'CD' end as status, event_type as title, case when value < 10 then null else event_type end as body from events)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming records made from events: small values delete, somewhat larger ones have no text."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 5, "DEL").otherwise("CD")
    return e.select(F.col("user_id").cast("string").alias("oid"), F.col("event_id").alias("seq"), status.alias("status"), F.col("event_type").alias("title"), F.when(F.col("value") < 10, None).otherwise(F.col("event_type")).alias("body"))


@query(f"with {_RECORDS} select status, count(*) as n from r group by status")
def spool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spool.checked(records(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {_RECORDS} select oid, seq, title, body from (select *, row_number() over (partition by oid order by seq desc) as n from r where status <> 'ERR') where n = 1 and status = 'CD'")
def spool_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spool.upserted(spool.checked(records(spark, sf_dir)))


@query("select doc_id, case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 when 'es' then 4 end as lang_code, source, n_chars from documents")
def docattr_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of all documents; texts are not read."""
    return docs(spark, sf_dir).select("doc_id", "lang_code", "source", "n_chars")


@query("select doc_id, text from documents where doc_id = 7")
def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id = 7").select("doc_id", "text")


@query("select doc_id, split_part(text, chr(10), 1) as value from documents")
def get_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("fields", F.create_map(F.lit("title"), F.col("title"), F.lit("body"), F.col("body")))
    return d.select("doc_id", F.col("fields")["title"].alias("value"))


@query(r"select doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '')[11:], ' ') as rest from documents")
def field_by_wordpos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", store.from_word(F.col("text"), 10).alias("rest"))


@query("select doc_id, coalesce(substr(text, 1 + cast(list_min(list_filter(range(0, 11), lambda c: strlen(substr(text, 1, cast(c as integer))) >= 10)) as integer)), '') as rest from documents")
def field_by_bytepos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from byte 10 on; a character that begins before it is left out whole."""
    return table(spark, sf_dir, "documents").select("doc_id", store.from_byte(F.col("text"), 10).alias("rest"))


@query("select doc_id, strlen(text) as bytes, length(text) as chars from documents")
def doc_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


@query("select max(doc_id) as last, count(*) as n from documents")
def last_docid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))


@query("select o.o_orderkey, c.c_custkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey")
def oid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey", "c_name")


@query("select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def docattr_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of every document by its id, -1 where it has none."""
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query(r"select page_id, url from pages where regexp_matches(url, '^[^/]*//[^/?#]*\.example\.(com|org)(/en/|/fr/)[^?#]*')")
def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.filter_pages(table(spark, sf_dir, "pages"), r".*\.example\.(?:com|org)", "/(?:en|fr)/.*").select("page_id", "url")


@query(r"select doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) as title, lang from documents")
def xml_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of XML made from the table, looked up whatever the case of names."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", src.xml_field(_xml(d), "/DOCUMENT/title").alias("title"), src.xml_field(_xml(d), '/document/field[@name="lang"]').alias("lang")).withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))


@query("select doc_id, cast(doc_id as varchar) as id, source as origin from documents")
def xml_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", src.xml_attribute(_xml(d), "/document", "ID").alias("id"), src.xml_attribute(_xml(d), "/Document/Field", "Origin").alias("origin"))


def _xml(d: DataFrame) -> Column:
    title = F.col("title")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('<Document Id="'), F.col("doc_id").cast("string"), F.lit('"><Title>'), title, F.lit('</Title><Field Name="lang" Origin="'), F.col("source"), F.lit('">'), F.col("lang"), F.lit("</Field></Document>"))


@query("select doc_id, '<doc><field name=\"doc_id\">' || doc_id || '</field><field name=\"lang\">' || lang || '</field></doc>' as xml, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' as json, doc_id || ',' || lang as csv from documents")
def result_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as XML, JSON and CSV."""
    d = docs(spark, sf_dir).select("doc_id", "lang")
    x = src.as_xml(d).select("xml", F.regexp_extract("xml", r">(\d+)<", 1).cast("long").alias("doc_id"))
    j = src.as_json(d).select("json", F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"))
    return x.join(j, "doc_id").join(d.select("doc_id", F.to_csv(F.struct("doc_id", "lang")).alias("csv")), "doc_id")


# ---------------------------------------------------------------- index
@query(f"{T} select doc_id, field, cast(pos as integer) as pos, word from t where word = 'thing'")
def posting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where("word = 'thing'").select("doc_id", "field", "pos", "word")


@query(f"{T} select word, doc_id, field, cast(pos as integer) as pos, n from (select *, row_number() over (partition by word order by doc_id, field, pos) as n from t) where n > 2 and n <= 5")
def posting_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.posting_slice(posts(spark, sf_dir), 2, 3).select("word", "doc_id", "field", "pos", "n")


@query(f"{T} select field, count(*) as hits, count(distinct word) as words, count(distinct doc_id) as docs, cast(sum(pos) as bigint) as positions from t group by field")
def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all postings by field."""
    return posts(spark, sf_dir).groupBy("field").agg(F.count("*").alias("hits"), F.count_distinct("word").alias("words"), F.count_distinct("doc_id").alias("docs"), F.sum("pos").alias("positions"))


@query(f"{T} select word, doc_id, bit_or(1 << field) as field_mask, count(*) as hits from t group by word, doc_id")
def posting_field_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).groupBy("word", "doc_id").agg(index.field_mask().alias("field_mask"), F.count("*").alias("hits"))


@query(f"{T} select doc_id, field, string_agg(word, ' ' order by pos) as words from t group by doc_id, field")
def forward_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.forward(posts(spark, sf_dir)).select("doc_id", "field", F.array_join("words", " ").alias("words"))


@query(f"{T} select row_number() over (order by word) as word_id, word, df from (select word, count(distinct doc_id) as df from t group by word)")
def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lexicon(index.document_words(docs(spark, sf_dir), C))


@query(f"{T}, x as (select row_number() over (order by word) as word_id, word, df from (select word, count(distinct doc_id) as df from t group by word)) select b.item_id, x.word_id, x.word from (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), {WORDS}))) as word from benchmark) b join x on b.word = x.word")
def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    return words.join(index.lexicon(index.document_words(docs(spark, sf_dir), C)), "word").select("item_id", "word_id", "word")


@query(f"{T} select count(distinct word) as words, count(*) as hits from t")
def lexicon_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).agg(F.count_distinct("word").alias("words"), F.count("*").alias("hits"))


@query(f"{T} select word, count(distinct doc_id) as df, count(*) as hits from t group by word")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequency(docs(spark, sf_dir), C)


@query(f"{T} select word, df_all as expected, df_body as found from (select word, count(distinct doc_id) as df_all, count(distinct doc_id) filter (where field = 1) as df_body from t group by word) where df_all <> df_body")
def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose postings in the body alone do not account for their document frequency."""
    p = posts(spark, sf_dir)
    return index.check(p.where("field = 1"), index.document_frequency(docs(spark, sf_dir), C))


# ---------------------------------------------------------------- sorting and dates
@query("select event_id, ts from events order by ts, event_id limit 50")
def sort_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(50)


@query("select o_orderkey, cast(strftime(o_orderdate, '%Y%m%d') as integer) as ymd from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-04-01' order by ymd desc, o_orderkey limit 40")
def search_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1996-03-01' and o_orderdate < timestamp'1996-04-01'")
    return o.select("o_orderkey", sc.yyyymmdd(F.col("o_orderdate")).alias("ymd")).orderBy(F.desc("ymd"), "o_orderkey").limit(40)


@query("select o_orderkey, cast(strftime(o_orderdate, '%Y%m%d') as integer) as ymd from orders")
def date_yyyymmdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.yyyymmdd(F.col("o_orderdate")).alias("ymd"))


@query("select o_orderkey, cast(strftime(o_orderdate - interval 30 day, '%Y%m%d') as integer) as ymd from orders")
def date_sub_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.yyyymmdd(F.date_sub("o_orderdate", 30)).alias("ymd"))


@query("select event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 as seconds from events")
def time_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", sc.seconds_between(before, F.col("ts"), None).alias("seconds"))


@query("select cast(time_bucket(interval 1 hour, ts) as varchar) as hour, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: event-time windows, as they run on streams."""
    w = spool.windowed_counts(table(spark, sf_dir, "events"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 3).alias("total"))


# ---------------------------------------------------------------- text analysis
@query(f"with {D}, {L} select doc_id, field, unnest(w) as word, cast(unnest(range(len(w))) as integer) as pos from l")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(f.number).alias("field"), text.words(F.col(f.name)).alias("w")) for f in C.fields])
    d = d.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.field", F.posexplode("f.w").alias("pos", "word"))
    return d.select("doc_id", "field", "word", "pos")


_KIND = r"case when regexp_matches(w, '^[\x{AC00}-\x{D7A3}]') then 'KOREAN' when regexp_matches(w, '^[\x{4E00}-\x{9FFF}]') then 'CHINESE' when regexp_matches(w, '^\p{N}') then 'NUMBER' when regexp_matches(w, '^\p{L}') then 'ALPHABET' else 'SPECIAL' end"
_SPLIT = r"select doc_id, unnest(x) as w, len(x) as n from (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]') as x from documents)"


@query(f"select kind, count(*) as n, count(distinct w) as words from (select *, {_KIND} as kind from ({_SPLIT})) group by kind")
def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("w"))
    return t.groupBy(text.kind(F.col("w")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("w").alias("words"))


@query(f"select doc_id, word, count(*) as n from (select doc_id, case when kind = 'NUMBER' then case when length(w) <= 8 and n > 1 then w end when kind = 'ALPHABET' then lower(w) end as word from (select *, {_KIND} as kind from ({_SPLIT}))) where word is not null group by doc_id, word")
def token_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("x"))
    t = t.select("doc_id", F.size("x").alias("n"), F.explode("x").alias("w"))
    return t.select("doc_id", text.dispatched(F.col("w"), F.col("n")).alias("word")).where("word is not null").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(r"select doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '')) as word from documents")
def analyze_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.analyze(F.col("text"), "whitespace")).alias("word"))


@query(f"with {D}, b as (select doc_id, flatten(list_transform(regexp_extract_all(lower(text), {WORDS}), lambda x: case when length(x) < 2 then [x] else list_transform(range(1, length(x)), lambda i: substr(x, cast(i as integer), 2)) end)) as w from documents) select word, count(*) as n from (select unnest(w) as word from b) group by word")
def analyze_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.explode(text.analyze(F.col("text"), "bigram")).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n"))


@query(rf"select doc_id, substr(upper(replace(array_to_string(regexp_extract_all(text, {WORDS}), ''), 'ß', 'SS')), 1, 39) as word from documents where len(regexp_extract_all(text, {WORDS})) > 0")
def analyze_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.analyze(F.col("text"), "concat")).alias("word"))


@query()
def stem_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem.stems(posts(spark, sf_dir))


_STOP = ", ".join(f"'{w}'" for w in STOP)


@query(f"{T} select doc_id, count(*) as words from t where word not in ({_STOP}) group by doc_id")
def stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where(~F.col("word").isin(*STOP)).groupBy("doc_id").agg(F.count("*").alias("words"))


@query(f"{T} select word, case when word in ({_STOP}) then 94 else 1 end as tag, count(*) as n from t where strlen(word) < 16 and word not in ({_STOP}) and not contains(word, '+') group by word")
def dictionary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries with their classes; noise words (class 94), long ones and those with "+" are left out."""
    tags = F.when(F.col("word").isin(*STOP), F.array(F.lit(94))).otherwise(F.array(F.lit(1)))
    d = posts(spark, sf_dir).where((F.octet_length("word") < 16) & ~F.col("word").contains("+")).groupBy("word").agg(F.count("*").alias("n")).withColumn("pos", tags)
    return d.where(~F.array_contains("pos", 94)).select("word", F.element_at("pos", 1).alias("tag"), "n")


@query("select doc_id, strpos(lower(text), 'licen') as at from documents where contains(lower(text), 'licen')")
def case_insensitive_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", sc.find_ci(F.lit("LICEN"), F.col("text")).cast("long").alias("at"))
    return d.where("at > 0")


@query("select doc_id, md5(text) as md5 from documents")
def doc_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"))


@query(f"{_R}, p as (select * from a order by relevance desc, doc_id limit 10) select p.doc_id, p.relevance, d.title, substr(d.body, 1, 255) as abstract from p join d on p.doc_id = d.doc_id")
def abstract_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are joined for the ten documents of the page only."""
    rows = engine(spark, sf_dir).run("SELECT doc_id, relevance, title, body SEARCH the & of ORDER_BY RELEVANCY DESC LIMIT 10")
    return rows.select("doc_id", "relevance", "title", F.substring("body", 1, 255).alias("abstract"))


@query(f"{_R}, p as (select * from a order by relevance desc, doc_id limit 10) select p.doc_id, d.body as abstract from p join d on p.doc_id = d.doc_id")
def abstract_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole field as abstract."""
    return engine(spark, sf_dir).run("SELECT doc_id, body SEARCH the & of ORDER_BY RELEVANCY DESC LIMIT 10").withColumnRenamed("body", "abstract")


@query(f"{T}, f as (select doc_id, min(pos) as pos from t where word = 'thing' and field = 1 group by doc_id) select f.doc_id, array_to_string(l.w[greatest(f.pos - 5, 0) + 1 : f.pos + 6], ' ') as snippet from f join l on f.doc_id = l.doc_id and l.field = 1")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", text.words(F.col("body")).alias("w"))
    d = d.withColumn("pos", F.array_position("w", "thing") - 1).where("pos >= 0")
    return d.select("doc_id", text.snippet(F.col("w"), F.col("pos")).alias("snippet"))


@query(r"select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), lambda x: case when lower(x) in ('the', 'of') then '<b>' || x || '</b>' else x end), '') as marked from documents")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.highlighted(F.col("text"), ["the", "of"]).alias("marked"))


# ---------------------------------------------------------------- scalar functions
_RECORD = "'HIT=' || (doc_id % 7) || '^DID=' || doc_id || '^OID=' || source || '^'"


def _record() -> Column:
    return F.concat(F.lit("HIT="), (F.col("doc_id") % 7).cast("string"), F.lit("^DID="), F.col("doc_id").cast("string"), F.lit("^OID="), F.col("source"), F.lit("^"))


@query("select doc_id, cast(doc_id % 7 as integer) as hit, doc_id as did, source as oid from documents")
def dit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", sc.dit_items(_record()).alias("m"))
    return d.select("doc_id", F.col("m")["HIT"].cast("int").alias("hit"), F.col("m")["DID"].cast("long").alias("did"), F.col("m")["OID"].alias("oid"))


@query("select doc_id, cast(doc_id as varchar) as item, source || '^' as rest, cast(null as varchar) as none from documents")
def str_get_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", sc.get_item(_record(), "DID=", "^").alias("item"), sc.get_item(_record(), "OID=").alias("rest"), sc.get_item(_record(), "X=").alias("none"))


@query("select page_id, cast(len(string_split(url, '/')) - case when ends_with(url, '/') then 1 else 0 end as integer) as n, 0 as none from pages")
def str_count_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sc.count_elements(F.col("url"), "/").alias("n"), sc.count_elements(F.lit(""), "/").alias("none"))


@query("select page_id, string_split(url, '/')[3] as host, coalesce(string_split(url, '/')[6], '') as sixth from pages")
def str_get_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", sc.get_element(u, "/", 2).alias("host"), sc.get_element(u, "/", 5).alias("sixth"))


@query("select page_id, case when contains(url, '=') then upper(split_part(url, '=', 1)) end as name, case when contains(url, '=') then substr(url, strpos(url, '=') + 1) end as value from pages")
def str_split_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sc.split_value(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", v["name"].alias("name"), v["value"].alias("value"))


_PAD = "' ' || chr(9) || source || chr(10) || ' '"


@query(f"select doc_id, length(trim({_PAD}, ' ' || chr(9) || chr(10) || chr(13))) as n, ltrim({_PAD}, ' ' || chr(9) || chr(10) || chr(13)) as l, rtrim({_PAD}, ' ' || chr(9) || chr(10) || chr(13)) as r from documents")
def str_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit(" \t"), "source", F.lit("\n "))
    return docs(spark, sf_dir).select("doc_id", F.length(sc.trimmed(p)).cast("long").alias("n"), sc.trimmed(p, "left").alias("l"), sc.trimmed(p, "right").alias("r"))


@query("select c_custkey, lower(c_mktsegment) = 'building' as same, lower(left(c_mktsegment, 3)) = 'aut' as begins from customer")
def str_equal_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", sc.equal_ci(s, F.lit("Building")).alias("same"), sc.equal_ci(s, F.lit("auto"), 3).alias("begins"))


@query("""with recursive s as (select n_name as name, 0 as i, cast(0 as bigint) as h from nation union all
select name, i + 1, xor((h * 16 + ord(substr(name, i + 1, 1))), ((h * 16 + ord(substr(name, i + 1, 1))) & 4026531840) >> 24) & 268435455 from s where i < length(name))
select name, h as hash, h % 8903 as bucket from s where i = length(name)""")
def elf_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return n.select("name", sc.elf_hash(F.col("name")).alias("hash"), sc.bucket(F.col("name")).alias("bucket"))


@query(r"select page_id, regexp_extract(url, '^[^/]*/[^/]*/(?:www\.)?([^/]*(?:/~[^/]*)?)', 1) as site from pages")
def url_to_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sc.url_to_site(F.col("url")).alias("site"))


@query("select doc_id, upper(source) as upper, lower(source) as lower, upper(left(source, 2)) || substr(source, 3) as first from documents")
def str_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    return docs(spark, sf_dir).select("doc_id", F.upper(s).alias("upper"), F.lower(s).alias("lower"), sc.upper_first(s, 2).alias("first"))


@query("select n_nationkey, word, row_number() over (order by case when ord(word) between 44032 and 55203 then 0 else 1 end, word collate C) as rank from (select n_nationkey, chr(cast(44032 + n_nationkey * 37 as integer)) as word from nation union all select n_nationkey + 100, n_name from nation)")
def order_hangul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in order, Hangul before others; ranks by ranges of the sort keys."""
    n = table(spark, sf_dir, "nation")
    words = n.select("n_nationkey", _syllable().alias("word")).union(n.select(F.col("n_nationkey") + 100, "n_name"))
    return words.withColumn("rank", F.row_number().over(Window.orderBy(*sc.hangul_order(F.col("word")))))


def _syllable() -> Column:
    return F.decode(F.unhex(F.hex(44032 + F.col("n_nationkey") * 37)), "UTF-16BE")


@query("select n_nationkey, cast((n_nationkey * 37) // 588 as integer) as initial, cast((n_nationkey * 37) % 588 // 28 as integer) as medial, cast((n_nationkey * 37) % 28 as integer) as final from nation")
def jamo_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", sc.jamo(_syllable()).alias("j"))
    return n.select("n_nationkey", "j.initial", "j.medial", "j.final")


@query("select doc_id, replace(source, 's', 'z') as replaced from documents")
def str_replace_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", sc.replace_char(F.col("source"), "s", "z").alias("replaced"))


@query("select doc_id, lpad(bin(doc_id & 65535), 16, '0') as bits from documents")
def to_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", sc.binary(F.col("doc_id"), 2).alias("bits"))


# ---------------------------------------------------------------- Korean, character sets, hooks, packed documents
_NOUN = "chr(cast(44032 + n_nationkey * 37 as integer)) || chr(cast(44032 + n_nationkey * 28 * 5 as integer))"


def _noun() -> Column:
    return F.concat(_syllable(), F.decode(F.unhex(F.hex(44032 + F.col("n_nationkey") * 28 * 5)), "UTF-16BE"))


@query(f"select n_nationkey, {_NOUN} as noun, p as particle, {_NOUN} || '|' || p as morphemes from nation, (values ('는'), ('에서'), ('로'), ('를')) v(p)")
def korean_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns with an open last syllable and a particle, taken apart again."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", _noun().alias("noun"), F.explode(F.array(*map(F.lit, ("는", "에서", "로", "를")))).alias("p"))
    w = F.concat("noun", "p")
    return n.select("n_nationkey", korean.stem(w).alias("noun"), korean.particle(w).alias("particle"), F.array_join(text.analyze(w, "morpheme"), "|").alias("morphemes"))


@query(f"select n_nationkey, x || x || '|' || x || '|' || x as compound, x || '|' || x as part from (select n_nationkey, {_NOUN} as x from nation)")
def korean_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(_noun(), _noun(), F.lit("는")).alias("w"))
    return n.select("n_nationkey", *[F.array_join(text.analyze(F.col("w"), a), "|").alias(a) for a in ("compound", "part")])


@query(f"select n_nationkey, {_NOUN} || n_name as back, cast(4 + length(n_name) as integer) as bytes from nation")
def charset_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to CP949 and back; a variation selector, which it lacks, is skipped."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", korean.to_cp949(F.concat(_noun(), F.lit("\ufe0f"), "n_name")).alias("raw"))
    return n.select("n_nationkey", korean.from_cp949("raw").alias("back"), F.octet_length("raw").alias("bytes"))


@query("select doc_id, lang, n_chars from documents where case lang when 'en' then n_chars > 500 when 'de' then n_chars <= 500 else true end")
def hook_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter operations by document type, here the language, from a registry; types without one pass."""
    hooks = Hooks()
    hooks.register("filter:en", "long", lambda rows: rows.where("n_chars > 500"), after=["skip"])
    hooks.register("filter:en", "skip", lambda rows: DECLINE)
    hooks.register("filter:de", "short", lambda rows: rows.where("n_chars <= 500"))
    d = docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    kinds = [F.col("lang") == "en", F.col("lang") == "de"]
    rest = d.where(~F.coalesce(F.col("lang").isin("en", "de"), F.lit(False)))
    return hooks.filtered(d.where(kinds[0]), "en").union(hooks.filtered(d.where(kinds[1]), "de")).union(hooks.filtered(rest, "other"))


@query("select doc_id, source as origin, cast(null as varchar) as long, lang as cut from documents")
def packed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by name: the first of two equal names counts, long names are cut."""
    f = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    d = docs(spark, sf_dir).select("doc_id", store.packed(F.array(f("origin", F.col("source")), f("origin", F.col("lang")), f("a_name_of_twenty_chars", F.col("lang")))).alias("m"))
    return d.select("doc_id", F.col("m")["origin"].alias("origin"), F.col("m")["a_name_of_twenty_chars"].alias("long"), F.col("m")["a_name_of_twenty_ch"].alias("cut"))


@query(f"{_R} select * from (select 'hit' as how, doc_id, row_number() over (order by relevance desc, doc_id) as rank from a union all select 'date', doc_id, row_number() over (order by n_chars desc, doc_id) from a union all select 'date_in_order', doc_id, row_number() over (order by n_chars, doc_id) from a) where rank <= 10")
def sort_how(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten by each way of sorting; n_chars stands for the date, which the table lacks."""
    e = engine(spark, sf_dir)
    found = e.found(parse("SELECT * SEARCH the of"))
    out = None
    for how in ("hit", "date", "date_in_order"):
        ten = e.sorted_by(found, how, "n_chars").limit(10)
        by = {"hit": F.desc("relevance"), "date": F.desc("n_chars"), "date_in_order": F.asc("n_chars")}[how]
        ten = ten.select(F.lit(how).alias("how"), "doc_id", F.row_number().over(Window.orderBy(by, "doc_id")).alias("rank"))
        out = ten if out is None else out.union(ten)
    return out


@query("select event_id, strftime(ts, '%Y/%m/%d at %H:%M:%S') as said from events")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sc.formatted(F.col("ts"), "%Y/%m/%d at %H:%M:%S").alias("said"))
