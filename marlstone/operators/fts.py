"""Full-text search over postings: a boolean query language ranked by BM25, and Okapi ranking.

An index is three tables: postings (term, chunk_id, positions), documents (chunk_id, length) and, by
aggregation, statistics. A query reads only the postings of its terms. Stored in order of term and chunk (see
``write_index``), files and row groups of other terms are skipped, for prefixes too.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import fixed
from marlstone.functions.text import FOLD_FROM, FOLD_TO, index_terms, terms

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(NEAR)\s*\(|([()+*,])|([^\s"()+*,]+))')
_WORD = re.compile(r"[^\W]|[./-]")


@dataclass
class Index:
    """postings: term, chunk_id, positions; documents: chunk_id, length."""

    postings: DataFrame
    documents: DataFrame


def build_index(chunks: DataFrame, key: str = "chunk_id", content: str = "content") -> Index:
    found = chunks.select(F.col(key).alias("chunk_id"), index_terms(F.coalesce(F.col(content), F.lit(""))).alias("_t"))
    postings = found.select("chunk_id", F.posexplode("_t").alias("_p", "term")).groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list("_p")).alias("positions"))
    return Index(postings, found.select("chunk_id", F.size("_t").cast("long").alias("length")))


def write_index(index: Index, path: str) -> None:
    """Postings ranged by term and chunk, so that a word in every document is spread over many files."""
    index.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"))


@dataclass
class Phrase:
    """Terms in a row, the last one maybe a prefix."""

    words: list[str]
    prefix: bool = False


@dataclass
class Node:
    """and, or, not (left without right), near, or phrase."""

    kind: str
    parts: list[Node] = field(default_factory=list)
    phrase: Phrase | None = None
    within: int = 10


def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def words_of(text: str) -> list[str]:
    """A query's terms, cut as the index cuts texts."""
    out, run = [], ""
    for c in fold(text):
        if _WORD.fullmatch(c):
            run += c
        elif run:
            out, run = [*out, run], ""
    return [*out, run] if run else out


class _Parser:
    """OR binds loosest, then AND, then NOT, then terms side by side, which mean AND."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read the query at {text[at:]!r}")
            quoted, near, mark, word = m.groups()
            self.tokens.append(("string", quoted.replace('""', '"')) if quoted is not None else ("near", "NEAR") if near else ("mark", mark) if mark else ("word", word))
            at = m.end()
        self.at = 0

    def peek(self, kind: str, value: str | None = None) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == kind and value in (None, self.tokens[self.at][1])

    def take(self, kind: str, value: str | None = None) -> str:
        if not self.peek(kind, value):
            raise ValueError(f"the query needs {value or kind} at token {self.at + 1}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def chain(self, word: str, below, kind: str) -> Node:
        node = below()
        while self.peek("word", word):
            self.at += 1
            node = Node(kind, [node, below()])
        return node

    def either(self) -> Node:
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.implicit, "not"), "and"), "or")

    def implicit(self) -> Node:
        node = self.single()
        while self.at < len(self.tokens) and not any(self.peek("word", w) for w in ("OR", "AND", "NOT")) and not self.peek("mark", ")"):
            node = Node("and", [node, self.single()])
        return node

    def single(self) -> Node:
        if self.peek("mark", "("):
            self.at += 1
            node = self.either()
            self.take("mark", ")")
            return node
        if self.peek("near"):
            self.at += 1
            parts = [self.phrase()]
            while not self.peek("mark", ",") and not self.peek("mark", ")"):
                parts.append(self.phrase())
            within = 10
            if self.peek("mark", ","):
                self.at += 1
                within = int(self.take("word"))
            self.take("mark", ")")
            return Node("near", parts, within=within)
        return self.phrase()

    def phrase(self) -> Node:
        if any(self.peek("word", w) for w in ("AND", "OR", "NOT")):
            raise ValueError(f"the query lacks a term at token {self.at + 1}")
        words = words_of(self.take("string") if self.peek("string") else self.take("word"))
        while self.peek("mark", "+"):
            self.at += 1
            words += words_of(self.take("string") if self.peek("string") else self.take("word"))
        prefix = self.peek("mark", "*")
        self.at += prefix
        return Node("phrase", phrase=Phrase(words, bool(prefix)))


def parse(text: str) -> Node:
    """A query of terms, "phrases", prefix*, a + b, NEAR(a b, n), AND, OR, NOT and parentheses; other syntax raises ValueError."""
    parser = _Parser(text)
    node = parser.either()
    if parser.at < len(parser.tokens):
        raise ValueError(f"the query goes on unexpectedly at token {parser.at + 1}")
    return node


def _phrases(node: Node) -> list[Node]:
    return [node] if node.kind == "phrase" else [p for part in node.parts for p in _phrases(part)]


def _scored(node: Node) -> list[Node]:
    """Phrases that can add to a score: what follows NOT can't."""
    return [node] if node.kind == "phrase" else [p for part in (node.parts[:1] if node.kind == "not" else node.parts) for p in _scored(part)]


def matches(index: Index, query: str) -> DataFrame:
    """(chunk_id, score) of all matching chunks; lower scores are better."""
    root = parse(query)
    phrases = _phrases(root)
    slots = sorted({(w, p.phrase.prefix and k == len(p.phrase.words) - 1) for p in phrases for k, w in enumerate(p.phrase.words)})
    is_slot = lambda word, prefix: F.col("term").startswith(word) if prefix else F.col("term") == word
    wanted = F.lit(False)
    for s in slots:
        wanted = wanted | is_slot(*s)
    postings = index.postings.filter(wanted)
    empty = F.array().cast("array<int>")
    rows = postings.groupBy("chunk_id").agg(*[F.coalesce(F.array_sort(F.flatten(F.collect_list(F.when(is_slot(*s), F.col("positions"))))), empty).alias(f"s{k}") for k, s in enumerate(slots)])
    place = {s: F.col(f"s{k}") for k, s in enumerate(slots)}

    def starts(p: Phrase) -> Column:
        if not p.words:
            return empty
        at = [place[w, p.prefix and k == len(p.words) - 1] for k, w in enumerate(p.words)]
        out = at[0]
        for k, other in list(enumerate(at))[1:]:
            # hashed, so it takes no time quadratic in the length of a text
            out = F.array_intersect(out, F.transform(other, _minus(k)))
        return out

    rows = rows.select("chunk_id", *[starts(p.phrase).alias(f"p{k}") for k, p in enumerate(phrases)])
    found = {id(p): F.size(f"p{k}") for k, p in enumerate(phrases)}

    def holds(node: Node) -> Column:
        if node.kind == "phrase":
            return found[id(node)] > 0
        if node.kind == "near":
            return near(node)
        a, b = (holds(x) for x in node.parts)
        return a & b if node.kind == "and" else a | b if node.kind == "or" else a & ~b

    def near(node: Node) -> Column:
        """Some start of each phrase such that the gap between the first one's end and the last one's start is small enough."""
        names = [f"p{[id(q) for q in phrases].index(id(p))}" for p in node.parts]
        size = [len(p.phrase.words) for p in node.parts]
        ok = F.lit(False)
        for k, name in enumerate(names):
            # the phrase that begins last: all others begin in reach before it
            others = [(F.col(names[j]), size[j]) for j in range(len(names)) if j != k]

            def in_reach(x: Column, others=others) -> Column:
                out = F.lit(True)
                for starts_at, length in others:
                    out = out & F.exists(starts_at, _before(x, length, node.within))
                return out

            ok = ok | F.exists(F.col(name), _unary(in_reach))
        return ok

    stats = index.documents.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    counted = rows.agg(*[F.count(F.when(F.size(f"p{k}") > 0, 1)).alias(f"d{k}") for k in range(len(phrases))])
    scored = rows.filter(holds(root)).join(index.documents, "chunk_id").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(counted))  # one row each
    score = F.lit(0.0)
    for k, p in enumerate(phrases):
        if any(p is q for q in _scored(root)):
            score = score + bm25(F.col("n"), F.col(f"d{k}"), F.size(f"p{k}"), F.col("length"), F.col("mean"))
    return scored.select("chunk_id", (-score).alias("score"))


def _unary(f):
    """f as a function of one argument, whatever defaults it has; Spark counts arguments."""
    return lambda x: f(x)


def _minus(k: int):
    return lambda x: x - k


def _before(x: Column, length: int, within: int):
    return lambda y: (y <= x) & (x - y - length <= within)


def bm25(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    k1, b = F.lit(fixed.FTS_K1), F.lit(fixed.FTS_B)
    idf = F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return F.when(idf <= 0, F.lit(fixed.FTS_LEAST_IDF)).otherwise(idf) * tf * (k1 + F.lit(1.0)) / (tf + k1 * (F.lit(1.0) - b + b * length / mean))


def search(index: Index, query: str, limit: int = 10) -> DataFrame:
    """The best matches; equal scores by chunk_id."""
    return matches(index, query).orderBy("score", "chunk_id").limit(limit)


def okapi(docs: DataFrame, query: str, key: str = "chunk_id", tokens: str = "tokens", partition: str | None = None) -> DataFrame:
    """(key, score) of documents that hold a term of the query; terms of the query count as often as they occur.

    partition: take statistics within each value of this column. An idf below zero is replaced by a quarter of the mean one.
    """
    spark = docs.sparkSession
    asked: dict[str, int] = {}
    for w in spark.range(1).select(F.explode(terms(F.lit(query)))).collect():
        asked[w[0]] = asked.get(w[0], 0) + 1
    part = [] if partition is None else [F.col(partition).alias("_part")]
    base = docs.select(F.col(key), *part, F.col(tokens).alias("_t"))
    if not asked:
        return base.select(key, F.lit(0.0).alias("score")).limit(0)
    words, by = list(asked), ["_part"] if part else []
    # one pass over the terms: the null term counts documents; how many terms have a frequency is a short list
    every = base.select(*by, F.size("_t").cast("double").alias("length"), F.explode(F.array_append(F.array_distinct("_t"), F.lit(None))).alias("term"))
    df = every.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("length").alias("length"))
    is_all = F.col("term").isNull()
    some = df.groupBy(*by, "df").agg(F.count("term").alias("times"), F.max(F.when(is_all, F.col("length"))).alias("length"), *[F.max(F.when(F.col("term") == w, 1)).alias(f"has{k}") for k, w in enumerate(words)])
    stats = some.groupBy(*by).agg(
        F.max(F.when(F.col("length").isNotNull(), F.col("df"))).alias("n"), F.max("length").alias("length"), F.collect_list(F.struct("df", "times")).alias("kinds"),
        *[F.max(F.when(F.col(f"has{k}") == 1, F.col("df"))).alias(f"d{k}") for k in range(len(words))],
    )
    raw = lambda d: F.ln(F.col("n") - d + F.lit(0.5)) - F.ln(d + F.lit(0.5))
    total = lambda f: F.aggregate("kinds", F.lit(0.0), lambda s, x: s + f(x))
    mean_idf = total(lambda x: raw(x["df"]) * x["times"]) / total(lambda x: x["times"].cast("double"))
    idf = [F.when(raw(F.col(f"d{k}")) < 0, F.lit(fixed.OKAPI_EPSILON) * F.col("mean_idf")).otherwise(raw(F.col(f"d{k}"))).alias(f"idf{k}") for k in range(len(words))]
    known = stats.withColumn("mean_idf", mean_idf).select(*by, (F.col("length") / F.col("n")).alias("mean"), *idf)
    tf = [F.size(F.filter("_t", _equals(w))).alias(f"tf{k}") for k, w in enumerate(words)]
    hits = base.select(key, *by, F.size("_t").alias("length"), *tf).filter(F.greatest(F.lit(0), *[F.col(f"tf{k}") for k in range(len(words))]) > 0)
    # a row, or one for each value of the partition
    joined = hits.join(known, "_part") if by else hits.crossJoin(F.broadcast(known))
    k1, b = F.lit(fixed.OKAPI_K1), F.lit(fixed.OKAPI_B)
    score = F.lit(0.0)
    for k, w in enumerate(words):
        one = F.lit(asked[w]) * F.col(f"idf{k}") * (F.col(f"tf{k}") * (k1 + F.lit(1.0)) / (F.col(f"tf{k}") + k1 * (F.lit(1.0) - b + b * F.col("length") / F.col("mean"))))
        score = score + F.when(F.col(f"tf{k}") > 0, one).otherwise(F.lit(0.0))
    return joined.select(key, *([F.col("_part").alias(partition)] if partition else []), score.alias("score"))


def _equals(word: str):
    return lambda t: t == word


def okapi_top(scored: DataFrame, k: int, key: str = "chunk_id", partition: str | None = None) -> DataFrame:
    """The k best of each partition, then of all; only scores over zero count."""
    if partition:
        best = Window.partitionBy(partition).orderBy(F.desc("score"), key)
        scored = scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")
    return scored.orderBy(F.desc("score"), key).limit(k).filter("score > 0")


def idf(n: int, df: int) -> float:
    """The index's idf of a term, for reference in tests."""
    x = math.log((n - df + 0.5) / (df + 0.5))
    return x if x > 0 else fixed.FTS_LEAST_IDF
