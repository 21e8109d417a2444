"""Evaluation of text expressions.

Every operand of an expression becomes one array column of hit keys per document, field number * 2^40 + position. Operators
work on those arrays: conjunction and disjunction are Boolean, a phrase intersects shifted arrays, a distance overlaps a
widened one. The arrays come either from the texts (scan: no shuffle, one pass) or from postings (index: one pass over the
postings of the words asked for, and one grouping by document); what follows is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import stem as stemmer
from loomdex.functions import text
from loomdex.operators.index import lookup
from loomdex.plans import dialect as d
from loomdex.schema import Collection, Field

SHIFT = 1 << 40


@dataclass(frozen=True)
class Options:
    """synonyms: word to other words, for SYN: operands. related: word to other words by kind of relation, for REL:. paragraph:
    pattern at which paragraphs end. stems: words of the collection that have an operand's stem, by stem, for MORP:; search()
    finds them where they are not given."""

    synonyms: Mapping[str, Iterable[str]] = field(default_factory=dict)
    related: Mapping[str, Mapping[str, Iterable[str]]] = field(default_factory=dict)
    stems: Mapping[str, Iterable[str]] = field(default_factory=dict)
    paragraph: str = r"\n"


def stem_word(word: str) -> str:
    return stemmer.stem(word.upper()).lower() if word.isascii() and word.isalpha() else word


#: Words of one stem beyond so many are an error: they become part of the plan.
MOST_FORMS = 10_000


def number_range(word: str) -> tuple[int, int]:
    """Bounds of a numeric operand: a number, or least~greatest, either of which may be missing."""
    least, mark, greatest = word.partition("~")
    try:
        low = int(least) if least else 0
        return low, (int(greatest) if greatest else 10**15 - 1) if mark else low
    except ValueError:
        raise d.DialectError(f"{word!r} is no number or range of numbers") from None


def forms(docs: DataFrame, collection: Collection, stem: str) -> tuple[str, ...]:
    """Distinct words of the indexed fields that have this stem. The stemmer changes at most the last two letters that a
    stem shares with its words, so words that begin otherwise are ruled out before Python sees any."""
    found = None
    for f in collection.indexed:
        words = docs.select(F.explode(text.words(F.col(f.name))).alias("word")).where(F.col("word").startswith(stem[: max(1, len(stem) - 2)]))
        found = words if found is None else found.union(words)
    got = [r["word"] for r in stemmer.stems(found).where(F.col("stem") == stem).select("word").limit(MOST_FORMS + 1).collect()]
    if len(got) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} words have the stem {stem!r}")
    return tuple(sorted(got))


def _accepts(term: d.Term, options: Options) -> Callable[[Column], Column]:
    """Whether a word of a document is a hit of the operand."""
    w = term.word
    if term.kind == "prefix":
        return lambda x: x.startswith(w)
    if term.kind == "suffix":
        return lambda x: x.endswith(w)
    if term.kind == "fuzzy":
        # the distance has no meaning for much longer or shorter words: their lengths decide first
        return lambda x: F.length(x).between(len(w) - term.n, len(w) + term.n) & (F.levenshtein(x, F.lit(w), term.n) >= 0)
    if term.kind == "synonym":
        return lambda x: x.isin(w, *options.synonyms.get(w, ()))
    if term.kind == "related":
        return lambda x: x.isin(w, *_related(w, options))
    if term.kind == "stem":
        return lambda x: x.isin(*options.stems.get(w, ())) if options.stems.get(w) else F.lit(False)
    if term.kind == "numeric":
        low, high = number_range(w)
        return lambda x: F.coalesce(F.when(x.rlike("^[0-9]{1,15}$"), x.cast("long")).between(low, high), F.lit(False))
    return lambda x: x == w


def _related(word: str, options: Options) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for words in options.related.get(word, {}).values() for w in words))


def _fields(scope: str | None, collection: Collection) -> tuple[Field, ...]:
    return tuple(f for f in collection.scope(scope) if f.indexed) if scope else collection.indexed


@dataclass
class Operand:
    """One array of hits: its name, fields, test of a word, words it can be looked up by (None: all), and weight."""

    name: str
    fields: tuple[Field, ...]
    accepts: Callable[[Column], Column]
    words: tuple[str, ...] | None
    weight: float = 1.0
    analyzer: str | None = None
    scored: bool = True


class Plan:
    """Operands of an expression, and its match and relevance over them."""

    def __init__(self, tree: object, collection: Collection, options: Options | None = None):
        self.collection, self.options, self.operands = collection, options or Options(), []
        self.paragraphs: list[tuple[d.Para, str]] = []
        self.match = self._match(tree)

    def _operand(self, term: d.Term, scope: str | None, scored: bool = True) -> Column:
        name = f"__k{len(self.operands)}"
        term = d.Term(stem_word(term.word), "stem", 0, term.fields, term.weight) if term.kind == "stem" else term
        words = {"word": (term.word,), "synonym": (term.word, *self.options.synonyms.get(term.word, ())), "related": (term.word, *_related(term.word, self.options)), "stem": tuple(self.options.stems.get(term.word, ()))}.get(term.kind)
        analyzer = "bigram" if term.kind == "bigram" else None
        self.operands.append(Operand(name, _fields(scope, self.collection), _accepts(term, self.options), words, term.weight, analyzer, scored))
        return F.col(name)

    def _chain(self, words: Iterable[d.Term], scope: str | None, weight: float) -> Column:
        """Starts of runs of hits of the words, one position after another."""
        out = None
        for i, term in enumerate(words):
            keys = self._operand(d.Term(term.word, term.kind, term.n, scope, weight), scope)
            moved = keys if i == 0 else _shifted(keys, i)
            out = moved if out is None else F.array_intersect(out, moved)
        return out

    def _match(self, node: object) -> Column:
        if isinstance(node, d.Op):
            if node.name == "not":
                left = self._match(node.left)
                before = len(self.operands)
                right = self._match(node.right)
                for o in self.operands[before:]:
                    o.scored = False
                return left & ~right
            left, right = self._match(node.left), self._match(node.right)
            return left & right if node.name == "and" else left | right
        if isinstance(node, d.Term):
            if node.kind == "bigram" and len(node.word) > 2:
                pairs = [d.Term(node.word[i : i + 2], "bigram") for i in range(len(node.word) - 1)]
                return F.size(self._chain(pairs, node.fields, node.weight)) > 0
            return F.size(self._operand(node, node.fields)) > 0
        if isinstance(node, d.Phrase):
            return F.size(self._chain([d.Term(w) for w in node.words], node.fields, node.weight)) > 0
        if isinstance(node, d.Within):
            a, b = self._operand(node.left, node.left.fields), self._operand(node.right, node.right.fields)
            reach = F.sequence(F.lit(-node.n - 1), F.lit(node.n + 1))
            wide = F.flatten(F.transform(a, lambda k: F.transform(F.filter(reach, lambda o: o != 0), lambda o: k + o)))
            return F.arrays_overlap(wide, b)
        if isinstance(node, d.Natural):
            return F.size(F.concat(*[self._operand(d.Term(w), node.fields) for w in node.words])) > 0
        if isinstance(node, d.Para):
            name = f"__p{len(self.paragraphs)}"
            for w in node.words:
                self._operand(d.Term(w), node.fields)
            self.paragraphs.append((node, name))
            return F.col(name)
        raise TypeError(f"no rule for {node!r}")

    @property
    def relevance(self) -> Column:
        """Sum over operands and fields of weights times number of hits. Operands on the right of a not do not count."""
        out = F.lit(0.0)
        for o in self.operands:
            if o.scored:
                for f in o.fields:
                    out = out + F.size(_in_field(F.col(o.name), f.number)) * F.lit(f.weight * o.weight)
        return out

    # ------------------------------------------------------------ where hits come from

    def scan(self, docs: DataFrame) -> DataFrame:
        """docs with the operands' arrays, straight from the texts."""
        kept = list(docs.columns)
        analyses = {}
        for o in self.operands:
            for f in o.fields:
                analyses[f.number, o.analyzer or f.analyzer] = f
        out = docs
        for (number, analyzer), f in analyses.items():
            words = F.coalesce(text.analyze(F.col(f.name), analyzer), F.array().cast("array<string>"))
            out = out.withColumn(f"__w{number}_{analyzer}", words)
        keys = {o.name: F.concat(*[_keys(F.col(f"__w{f.number}_{o.analyzer or f.analyzer}"), f.number, o.accepts) for f in o.fields]) for o in self.operands}
        for node, name in self.paragraphs:
            keys[name] = self._paragraph(node)
        return out.withColumns(keys).select(*kept, *keys)

    def _paragraph(self, node: d.Para) -> Column:
        found = []
        for f in _fields(node.fields, self.collection):
            parts = F.split(F.coalesce(F.col(f.name), F.lit("")), self.options.paragraph)
            found.append(F.exists(parts, lambda p: F.size(F.array_intersect(text.words(p), F.array(*[F.lit(w) for w in set(node.words)]))) == len(set(node.words))))
        out = found[0]
        for x in found[1:]:
            out = out | x
        return out

    def index(self, found: DataFrame, universe: DataFrame | None = None) -> DataFrame:
        """(id, arrays) from postings (doc_id, field, pos, word): documents with a hit; with universe, all of its ids."""
        if self.paragraphs or any(o.analyzer for o in self.operands):
            raise d.DialectError("PARA: and BIGRAM: need the texts or postings of their own analyser")
        exact = sorted({w for o in self.operands if o.words for w in o.words})
        wanted = F.col("word").isin(*exact) if exact else F.lit(False)
        for o in self.operands:
            if o.words is None:
                wanted = wanted | o.accepts(F.col("word"))
        key = F.col("field").cast("long") * SHIFT + F.col("pos")
        lists = [F.sort_array(F.collect_list(F.when(F.col("field").isin(*[f.number for f in o.fields]) & o.accepts(F.col("word")), key))).alias(o.name) for o in self.operands]
        out = found.where(wanted).groupBy("doc_id").agg(*lists).withColumnRenamed("doc_id", self.collection.id_col)
        if universe is not None:
            out = universe.select(self.collection.id_col).join(out, self.collection.id_col, "left")
            out = out.withColumns({o.name: F.coalesce(o.name, F.array().cast("array<bigint>")) for o in self.operands})
        return out


def _shifted(keys: Column, by: int) -> Column:
    return F.transform(keys, lambda k: k - by)


def _in_field(keys: Column, number: int) -> Column:
    return F.filter(keys, lambda k: F.shiftright(k, 40) == number)


def _keys(words: Column, number: int, accepts: Callable[[Column], Column]) -> Column:
    at = F.transform(words, lambda x, i: F.when(accepts(x), F.lit(number * SHIFT) + i.cast("long")))
    return F.filter(at, lambda k: k.isNotNull())


def with_stems(docs: DataFrame, tree: object, collection: Collection, options: Options | None) -> Options:
    """options with the words of every MORP: operand's stem, looked up among the words of docs."""
    options = options or Options()
    asked = {stem_word(t.word) for t in d.leaves(tree) if isinstance(t, d.Term) and t.kind == "stem"} - set(options.stems)
    return replace(options, stems={**options.stems, **{s: forms(docs, collection, s) for s in sorted(asked)}}) if asked else options


def search(docs: DataFrame, source: str, collection: Collection, options: Options | None = None, postings: DataFrame | None = None) -> DataFrame:
    """docs that match a text expression, with relevance. With postings, hits come from them and docs is joined by id; of
    postings in buckets, as index.write() leaves them, the buckets of the words are read if all operands name their words."""
    tree = d.parse_text(source)
    plan = Plan(tree, collection, with_stems(docs, tree, collection, options))
    if postings is None:
        found = plan.scan(docs)
        return found.withColumn("relevance", plan.relevance).where(plan.match).select(*docs.columns, "relevance")
    if "bucket" in postings.columns and all(o.words is not None for o in plan.operands):
        postings = lookup(postings, sorted({w for o in plan.operands for w in o.words}))
    found = plan.index(postings).withColumn("relevance", plan.relevance).where(plan.match).select(collection.id_col, "relevance")
    if docs.columns == [collection.id_col]:
        return found
    return docs.join(found, collection.id_col).select(*docs.columns, "relevance")


def hits(docs: DataFrame, source: str, collection: Collection, options: Options | None = None) -> DataFrame:
    """(id, field, pos, operand): where the operands of an expression hit, of documents that match it."""
    tree = d.parse_text(source)
    plan = Plan(tree, collection, with_stems(docs, tree, collection, options))
    found = plan.scan(docs).where(plan.match)
    each = F.array(*[F.struct(F.lit(i).alias("operand"), F.col(o.name).alias("keys")) for i, o in enumerate(plan.operands)])
    rows = found.select(collection.id_col, F.explode(each).alias("o")).select(collection.id_col, F.col("o.operand").alias("operand"), F.explode("o.keys").alias("key"))
    return rows.select(collection.id_col, F.shiftright("key", 40).cast("int").alias("field"), (F.col("key") % SHIFT).cast("int").alias("pos"), "operand")
