"""Operator 13: how far the sources of a language diverge in their words, by chunk factorization.

A text is a row of chunks between ASCII white space; no term crosses white space. Every task counts the chunks of its
documents, in blocks of bounded size, and sends one row a distinct chunk: occurrences and documents for every group (a
source of a language), and the documents' numbers where they are few. In the order of chunks these rows are combined, so
each globally distinct chunk is tokenized once, by Spark's own functions, and its counts are joined to its terms. In the
order of terms they are combined again: occurrences are added up, and a term is kept in a language if one of its chunks
alone stands in enough documents or the distinct documents of all its chunks are enough. No more documents are
remembered for a term than that takes, and no more than one chunk or term is held while rows stream past.

Terms are runs of characters other than ASCII ones that are not letters, with A-Z lower-cased. Null text, language or
source reads as ''. Each language keeps the terms in at least `least` of its documents (V of them). With N occurrences of kept terms
in a group or a whole language, a term's weight is p = 1 + floor(10^9 (count + 5) / (N + 5 V)),
in whole numbers. Every group has a weight for every kept term, so terms that a source lacks need no rows: they share one weight.

Sums of |p - q| over all terms of two sources are built from blocks of terms and sources: a task holds the weights of
at most 2 * `SOURCES` sources for about `TERMS` terms and returns one number a pair. Repeated rows are documents of their
own; documents need no id. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlane.functions.sizes import broadcast_if_small
from voltlane.llm.common import Stages, col, register, slices, table

LEAST_DOCUMENTS = 30
TOP = 50
#: Bytes of text in a block, but for a longer text, which is a block of its own.
BLOCK = 16_000_000
#: Sources and terms that are compared at once.
SOURCES = 256
TERMS = 4_096
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = 50_000


def _binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of `values`, so many numbers in each, as binaries."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of binaries, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1)) if len(sorted_keys) else np.zeros(0, np.int64)


class Counts(NamedTuple):
    """Counts by key (a chunk or a term, numbered in order): occurrences for every group, documents for every language."""

    key: np.ndarray
    lang: np.ndarray
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray
    """Documents of the key in the group."""
    doc_key: np.ndarray
    doc_lang: np.ndarray
    doc: np.ndarray
    """Numbers of documents; ENOUGH: the language needs none."""

    def and_then(self, other: Counts) -> Counts:
        return Counts(*(np.concatenate(pair) for pair in zip(self, other, strict=True)))

    def of_keys(self, keep: np.ndarray, shift: int = 0) -> Counts:
        """Only the keys where `keep` holds, renumbered by `shift`."""
        a, b = keep[self.key], keep[self.doc_key]
        picked = [x[a] for x in self[:5]] + [x[b] for x in self[5:]]
        return Counts(*picked)._replace(key=picked[0] - shift, doc_key=picked[5] - shift)


#: Stands for the documents of a key and language that have been found to be enough.
ENOUGH = -1


def combined(c: Counts, least: int, disjoint: bool) -> Counts:
    """One entry a key and group, one a key, language and document; documents of languages with enough of them go.

    `disjoint`: entries of one key never share a document (those of one chunk), so their documents may be added up.
    """
    width = int(c.group.max()) + 1 if len(c.group) else 1
    order = np.argsort(c.key * width + c.group, kind="stable")
    sorted_keys = (c.key * width + c.group)[order]
    at = _runs(sorted_keys)
    total = lambda x: np.add.reduceat(x[order], at) if len(at) else x[:0]
    key, lang, group, n, docs = c.key[order][at], c.lang[order][at], c.group[order][at], total(c.n), total(c.docs)

    # languages, numbered by key
    langs = int(c.lang.max()) + 1 if len(c.lang) else 1
    slot = key * langs + lang
    by_slot = np.argsort(slot, kind="stable")
    first = _runs(slot[by_slot])
    enough = slot[by_slot][first][np.add.reduceat(docs[by_slot], first) >= least] if disjoint and len(first) else np.zeros(0, np.int64)

    own = c.doc_key * langs + c.doc_lang
    by_doc = np.lexsort((c.doc, own))
    own, doc = own[by_doc], c.doc[by_doc]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    own, doc = own[new], doc[new]
    starts = _runs(own)
    sizes = np.diff(starts, append=len(own))
    settled = (doc[starts] == ENOUGH) | (sizes >= least) if len(starts) else np.zeros(0, bool)
    enough = np.unique(np.concatenate([enough, own[starts][settled]]))
    left = ~np.isin(own, enough)
    doc_slot = np.concatenate([own[left], enough])
    doc = np.concatenate([doc[left], np.full(len(enough), ENOUGH, np.int64)])
    return Counts(key, lang, group, n, docs, doc_slot // langs, doc_slot % langs, doc)


def _counted_chunks(least: int, limit: int):
    """Rows (task, chunk, heads, docs) of a task's documents: lang, group, occurrences and documents; the numbers of few documents."""

    def of_block(texts: list[pa.Array], langs: np.ndarray, groups: np.ndarray, task: int, first: int):
        split = pa.concat_arrays([pc.ascii_split_whitespace(t) for t in texts])
        lengths = pc.list_value_length(split).to_numpy()
        coded = split.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if not len(chunks):
            return
        # distinct chunks of every document, with counts
        pairs, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * len(chunks) + codes, return_counts=True)
        doc, code = pairs // len(chunks), pairs % len(chunks)
        order = np.lexsort((groups[doc], code))
        doc, code, n = doc[order], code[order], n[order]
        width = int(groups.max()) + 1
        at = _runs(code * width + groups[doc])
        docs = np.diff(at, append=len(doc))
        heads = np.stack([langs[doc[at]], groups[doc[at]], np.add.reduceat(n, at), docs], axis=1).astype(np.int32)
        per_chunk = np.bincount(code[at], minlength=len(chunks))
        few = np.repeat(docs < least, docs)
        ids = (first + doc[few]).astype(np.int32)
        per_chunk_ids = np.bincount(code[few], minlength=len(chunks))
        columns = [pa.array(np.full(len(chunks), task, np.int32)), chunks, _binaries(heads.ravel(), per_chunk * 4), _binaries(ids, per_chunk_ids)]
        whole = pa.RecordBatch.from_arrays(columns, names=["task", "chunk", "heads", "docs"])
        for start in range(0, len(chunks), _ROWS):
            yield whole.slice(start, _ROWS)

    def counted(batches):
        from pyspark import TaskContext

        task, first, size, texts, langs, groups = TaskContext.get().partitionId(), 0, 0, [], [], []
        for batch in batches:
            for piece in slices(batch, 0, limit):
                if texts and size + piece.column(0).nbytes > limit:
                    yield from of_block(texts, np.concatenate(langs), np.concatenate(groups), task, first)
                    first, size, texts, langs, groups = first + sum(map(len, texts)), 0, [], [], []
                size += piece.column(0).nbytes
                texts.append(piece.column(0).cast(pa.string()))
                langs.append(piece.column(1).to_numpy().astype(np.int64))
                groups.append(piece.column(2).to_numpy().astype(np.int64))
        if texts:
            yield from of_block(texts, np.concatenate(langs), np.concatenate(groups), task, first)

    return counted


def _from_chunk_rows(batch: pa.RecordBatch, keys: np.ndarray, least: int) -> Counts:
    heads, per_row = _numbers(batch.column("heads"), np.int32)
    heads = heads.reshape(-1, 4).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), per_row // 4)
    ids, _ = _numbers(batch.column("docs"), np.int32)
    counts = np.where(heads[:, 3] < least, heads[:, 3], 0)
    task = batch.column("task").to_numpy().astype(np.int64) << 32
    return Counts(keys[row], *heads.T, np.repeat(keys[row], counts), np.repeat(heads[:, 0], counts), np.repeat(task[row], counts) + ids)


def _from_term_rows(batch: pa.RecordBatch, keys: np.ndarray, least: int) -> Counts:
    heads, per_row = _numbers(batch.column("heads"), np.int64)
    heads = heads.reshape(-1, 3)
    docs, per_doc_row = _numbers(batch.column("docs"), np.int64)
    docs = docs.reshape(-1, 2)
    return Counts(np.repeat(keys, per_row // 3), *heads.T, np.zeros(len(heads), np.int64), np.repeat(keys, per_doc_row // 2), *docs.T)


def _chunk_rows(names: pa.Array, c: Counts) -> pa.RecordBatch:
    order = np.argsort(c.doc_key, kind="stable")
    heads = np.stack([c.lang, c.group, c.n], axis=1)
    docs = np.stack([c.doc_lang[order], c.doc[order]], axis=1)
    size = lambda keys: np.bincount(keys, minlength=len(names))
    return pa.RecordBatch.from_arrays([names, _binaries(heads.ravel(), size(c.key) * 3), _binaries(docs.ravel(), size(c.doc_key) * 2)], names=["chunk", "heads", "docs"])


def _kept_rows(names: pa.Array, c: Counts) -> pa.RecordBatch:
    """Entries of keys and languages with enough documents."""
    langs = max(int(x.max()) + 1 if len(x) else 1 for x in (c.lang, c.doc_lang))
    kept = np.isin(c.key * langs + c.lang, (c.doc_key * langs + c.doc_lang)[c.doc == ENOUGH])
    return pa.RecordBatch.from_arrays(
        [pa.array(c.group[kept].astype(np.int32)), names.take(pa.array(c.key[kept])), pa.array(c.n[kept])], names=["group", "term", "n"]
    )


def _in_order(name: str, load, emit, least: int, disjoint: bool):
    """Combines rows that come in the order of column `name`; the last key of a batch waits for the next, combined so far."""

    def stream(batches):
        waiting, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(name)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            names = column.filter(pa.array(new))
            same = waiting is not None and key == names[0].as_py()
            numbers = np.cumsum(new) - 1 + (0 if waiting is None or same else 1)
            counts = load(batch, numbers, least)
            if waiting is not None:
                counts = waiting.and_then(counts)
                names = names if same else pa.concat_arrays([pa.array([key], names.type), names])
            counts = combined(counts, least, disjoint)
            done = np.ones(len(names), bool)
            done[-1] = False
            if len(names) > 1:
                yield emit(names[:-1], counts.of_keys(done))
            waiting, key = counts.of_keys(~done, len(names) - 1), names[-1].as_py()
        if waiting is not None:
            yield emit(pa.array([key], pa.string()), waiting)

    return stream


def terms_of(chunk: Column) -> Column:
    """The terms of a chunk in order."""
    return F.regexp_extract_all(F.translate(chunk, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def count_terms(
    df: DataFrame, stages: Stages, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of the terms that stand in `least` documents of their language, and (lang, source) of all groups."""
    blank = lambda c, name: F.coalesce(col(c).cast("string"), F.lit("")).alias(name)
    rows = df.select(blank(text, "text"), blank(lang, "lang"), blank(source, "source"))
    groups = stages(rows.select("lang", "source").distinct(), "groups")
    number = lambda f, *order: (f().over(Window.orderBy(*order)) - 1).cast("int")
    numbered = stages(groups.select("lang", "source", number(F.dense_rank, "lang").alias("l"), number(F.row_number, "lang", "source").alias("g")), "numbered")
    small = broadcast_if_small(numbered)
    docs = rows.join(small, ["lang", "source"]).select("text", "l", "g")
    if small is numbered:
        # documents are numbered by their place, which must be the same whenever a task is repeated
        docs = stages(docs, "documents")
    in_chunks = docs.mapInArrow(_counted_chunks(least, block), "task int, chunk string, heads binary, docs binary")
    by_chunk = in_chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
        _in_order("chunk", _from_chunk_rows, _chunk_rows, least, True), "chunk string, heads binary, docs binary"
    )
    # a term that stands in a chunk twice comes twice, with its occurrences
    in_terms = by_chunk.select(F.explode(terms_of(F.col("chunk"))).alias("term"), "heads", "docs")
    by_term = in_terms.repartition("term").sortWithinPartitions("term").mapInArrow(
        _in_order("term", _from_term_rows, _kept_rows, least, False), "group int, term string, n bigint"
    )
    named = numbered.select("lang", "source", F.col("g").alias("group"))
    return stages(by_term.join(broadcast_if_small(named), "group").select("lang", "source", "term", "n"), "terms"), groups


def _weight(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exact. 1 where nothing is kept."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    below = f"({wide(total)} + 5 * {wide(kept)})"
    return F.expr(f"1 + case when {kept} = 0 then 0 else (cast(1000000000 as decimal(10,0)) * ({wide(n)} + 5)) div {below} end")


class Weights:
    """The tables of weights that both parts of the audit read, written once."""

    def __init__(self, terms: DataFrame, groups: DataFrame, stages: Stages):
        whole = stages(terms.groupBy("lang", "term").agg(F.sum("n").alias("n")), "kept")
        langs = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total"))
        langs = groups.select("lang").distinct().join(langs, "lang", "left").na.fill(0)
        #: lang, kept, total
        self.langs = langs = broadcast_if_small(stages(langs, "langs"))
        own = terms.join(whole.select("lang", "term", F.col("n").alias("n_lang")), ["lang", "term"]).select("lang", "source", "term", "n", "n_lang")
        own = stages(own, "own")
        slot = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        sums = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").na.fill(0, ["n"])
        sums = sums.join(langs.select("lang", "kept"), "lang").withColumn("zero", F.lit(0))
        #: lang, source, slot (number of the source in its language), n, kept, zero (weight of a term that the source lacks)
        self.groups = groups = stages(sums.select("lang", "source", slot.alias("slot"), "n", "kept", _weight("zero", "n", "kept").alias("zero")), "weights")
        p = own.join(broadcast_if_small(groups.select("lang", "source", "slot", "zero", "kept", F.col("n").alias("total"))), ["lang", "source"])
        p = p.join(langs.select("lang", F.col("total").alias("total_lang")), "lang")
        #: lang, source, slot, zero, term, p, q: weights of the terms that a source has, and those of its language
        self.terms = stages(p.select("lang", "source", "slot", "zero", "kept", "term", _weight("n", "total", "kept").alias("p"), _weight("n_lang", "total_lang", "kept").alias("q")), "p")


def _apart(key, rows: pa.Table, size: int) -> pa.Table:
    """Over the terms of one bucket, sums of |p_a - p_b| - |zero_a - zero_b| for sources of two blocks, one row a pair.

    Every source of the two blocks has one row without term, the terms it has come in rows of their own.
    """
    lang, low, high, _ = (k.as_py() for k in key)
    with_term = rows.filter(pc.is_valid(rows.column("term")))
    sources = rows.filter(pc.is_null(rows.column("term"))).sort_by("slot")
    known, zero = sources.column("slot").to_numpy(), sources.column("zero").to_numpy()
    terms = with_term.column("term").combine_chunks().dictionary_encode()
    p = np.repeat(zero[:, None], len(terms.dictionary), axis=1)
    p[np.searchsorted(known, with_term.column("slot").to_numpy()), terms.indices.to_numpy()] = with_term.column("p").to_numpy()
    left, right = np.flatnonzero(known // size == low), np.flatnonzero(known // size == high)
    more = [np.abs(p[right] - p[i]).sum(axis=1) - p.shape[1] * np.abs(zero[right] - zero[i]) for i in left]
    a, b = np.repeat(known[left], len(right)), np.tile(known[right], len(left))
    off = a != b
    return pa.table({
        "lang": pa.array([lang] * int(off.sum()), pa.string()), "a": pa.array(a[off], pa.int32()), "b": pa.array(b[off], pa.int32()),
        "more": pa.array(np.concatenate([np.zeros(0, np.int64), *more])[off], pa.int64()),
    })


def pairs(w: Weights, size: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language: the sum of |p - q| over all kept terms.

    Terms that both sources lack add |zero_a - zero_b| each; so do all others at first, and `_apart` adds what they differ by.
    A row of a term goes to the block pairs that its source takes part in, so it is copied once for every `size` sources.
    """
    counted = w.groups.where("kept > 0").withColumn("buckets", F.ceil(F.col("kept") / terms).cast("int"))
    last = counted.groupBy("lang").agg(F.floor(F.max("slot") / size).cast("int").alias("last"))
    whole = counted.select("lang", "slot", "zero", F.lit(None).cast("string").alias("term"), col("zero").alias("p"), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    bucket = F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / terms)).cast("int").alias("bucket")
    own = F.floor(F.col("slot") / size).cast("int")
    dealt = (
        whole.unionByName(w.terms.select("lang", "slot", "zero", "term", "p", bucket))
        .join(broadcast_if_small(last), "lang")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("lang", F.least("other", own).alias("low"), F.greatest("other", own).alias("high"), "bucket", "slot", "zero", "term", "p")
    )
    more = dealt.groupBy("lang", "low", "high", "bucket").applyInArrow(lambda key, rows: _apart(key, rows, size), "lang string, a int, b int, more bigint")
    # within one block both orders come out; across blocks the lower one first only
    across = F.floor(F.col("a") / size) != F.floor(F.col("b") / size)
    turned = F.explode(F.when(across, F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).otherwise(F.array(F.struct("a", "b"))))
    summed = more.groupBy("lang", "a", "b").agg(F.sum("more").alias("more")).select("lang", turned.alias("t"), "more").select("lang", "t.a", "t.b", "more")
    a = w.groups.select("lang", "source", F.col("slot").alias("a"), F.col("zero").alias("zero_a"), "kept")
    b = w.groups.select("lang", F.col("source").alias("item"), F.col("slot").alias("b"), F.col("zero").alias("zero_b"))
    value = F.col("kept") * F.abs(F.col("zero_a") - F.col("zero_b")) + F.coalesce("more", F.lit(0))
    return a.join(b, "lang").where("a <> b").join(summed, ["lang", "a", "b"], "left").select("lang", "source", "item", value.alias("value"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms that a source has more of than its language."""
    stages = Stages(df.sparkSession, "divergence")
    w = Weights(*count_terms(df, stages, text, lang, source, least, block), stages)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = w.terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    first = first.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    apart = pairs(w, sources, terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return apart.unionByName(first)


SQL = r"""
with d as (select row_number() over () as i, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as materialized (select i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as materialized (select lang, term, count(*) as n from t group by all having count(distinct i) >= 30),
groups as materialized (select distinct lang, source from d),
v as (select lang, count(term) as v, coalesce(sum(n), 0) as n from (select distinct lang from d) left join kept using (lang) group by lang),
own as materialized (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
total as (select lang, source, coalesce(sum(n), 0) as n from groups left join own using (lang, source) group by all),
p as materialized (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(o.n, 0) + 5)) // (g.n + 5 * v.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (v.n + 5 * v.v) as q
  from total g join v using (lang) join kept k using (lang) left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
pair as (
  select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
    on x.lang = a.lang and x.source = a.source and x.item = b.source),
parts as (
  select lang, source, 'pair' as part, item, value from pair
  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 50
"""


@register("op13_source_divergence", SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
