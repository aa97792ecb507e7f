"""Language-model scores: prediction by partial matching over a byte-context trie.

Texts are read as their words (A-Z in lower case) with one blank between and an end byte. The model
counts, over all training texts, each byte after its ``ORDER`` preceding ones; shorter contexts sum the
longer ones. A byte that its longest known context has not seen escapes to the next shorter one. Each
distinct byte of a context gives half a count to the escape (method D), and bytes the longer context has
seen are excluded. After the empty context all bytes not yet seen are alike. The sum of log
probabilities is a text's code length under the pretrained model.

A gram is a context and its byte. Counts stay in the cluster: every distinct gram that any text has is
priced once there, in the task that holds all grams with the same three bytes of context, where the
levels of three to ``ORDER`` bytes nest. What it needs of the shorter levels is its trigram's count, which
is joined to it, and tables of at most 65,536 entries, which every task gets. Texts are then scored in two
ways that give the same sums: the commonest grams and words, at most ``max_grams`` and ``top_words``, by
lookup in a broadcast table, all others by a shuffle. No count is dropped, whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import id_residue, lean, materialize, sized_slices

ORDER = 5
END = "\n"
_BATCH = 1 << 20
_POSITIONS = 1 << 21
_PRICED = 1 << 18
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def split_words(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """(words of each text, A-Z in lower case; number of them). A text without a word has one empty entry."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a slice may begin within its buffers, which casting keeps and lower-casing misreads
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    listed = pc.ascii_split_whitespace(trimmed)
    return listed, np.where(pc.binary_length(trimmed).to_numpy() == 0, 0, pc.list_value_length(listed).to_numpy()).astype(np.int64)


def scored_positions(listed: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all scored bytes, number of them in each text): end bytes as a first context, the words, an end byte."""
    kind = pa.large_string()
    streams = pc.binary_join_element_wise(pa.scalar(END * ORDER, kind), pc.binary_join(listed, pa.scalar(" ", kind)), pa.scalar(END, kind), pa.scalar("", kind))
    ends = np.frombuffer(streams.buffers()[1], np.int64, len(streams) + 1, 8 * streams.offset)
    return _grams(np.frombuffer(streams.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.diff(ends))


def _grams(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) - ORDER
    grams = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        grams = grams << 8 | data[k : k + n]
    first = np.cumsum(size)[:-1]
    inside = np.ones(n, bool)
    for k in range(ORDER):  # bytes of a next text's padding are not scored
        inside[first - ORDER + k] = False
    return grams[inside], size - ORDER


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, rising; their counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.concatenate((first, [len(keys)]))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, n, m) from (text, held_out): n in training texts, m in all. Tasks count in arrays before the shuffle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            key, m = part
            return pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(np.where(key & 1, 0, m)), pa.array(m)], ["gram", "n", "m"])

        waiting, parts, size, kept = [], [], 0, 0
        for batch in sized_slices(batches, 0, _BATCH):
            grams, sizes = scored_positions(split_words(batch.column(0))[0])
            waiting.append(grams << 1 | np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), sizes))
            size += len(grams)
            if size >= _POSITIONS:
                parts.append(_counted(np.concatenate(waiting)))
                waiting, size = [], 0
                kept += len(parts[-1][0])
                if kept > _POSITIONS:
                    parts = [_counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
                    kept = len(parts[0][0])
                    if kept > _POSITIONS // 2:
                        yield out(parts[0])
                        parts, kept = [], 0
        if waiting:
            parts.append(_counted(np.concatenate(waiting)))
        if parts:
            yield out(_counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])))

    counted = rows.select("text", "held_out").mapInArrow(run, "gram long, n long, m long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; each batch sends each of its words once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 0, 8 * _BATCH):
            found = split_words(batch.column(0))[0].flatten().value_counts()
            there = pc.not_equal(found.field("values"), "")
            yield pa.RecordBatch.from_arrays([found.field("values").filter(there).cast(pa.string()), found.field("counts").filter(there)], ["word", "c"])

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Short:
    """The levels of no, one and two bytes of context, by number of the gram or context; of fixed size."""

    zero: np.ndarray  # counts of 256 bytes
    one: np.ndarray  # counts of 65,536 bigrams
    total: np.ndarray  # of 65,536 contexts of two bytes: counts,
    kinds: np.ndarray  # distinct bytes,
    excluded: np.ndarray  # and what their bytes have after the shorter context

    def levels(self) -> list[tuple[np.ndarray, ...]]:
        """For two, one and no bytes: (total, kinds, total and kinds left to the next shorter one) by context."""
        table = self.one.reshape(256, 256)
        total, kinds = table.sum(1), (table > 0).sum(1)
        all_total, all_kinds = self.zero.sum(), (self.zero > 0).sum()
        last = np.arange(65536) & 255
        none = np.zeros(1)
        return [
            (self.total, self.kinds, total[last] - self.excluded, kinds[last] - self.kinds),
            (total, kinds, all_total - ((table > 0) * self.zero).sum(1), all_kinds - kinds),
            (np.array([all_total]), np.array([all_kinds]), none, none),
        ]


def short_levels(trigrams: DataFrame) -> Short:
    """From (tri, n2), a written table. The driver gets at most 65,536 rows twice."""
    pairs = materialize(trigrams.groupBy(F.col("tri").bitwiseAND(F.lit(65535)).alias("pair")).agg(F.sum("n2").alias("n1")), "pairs")
    per = trigrams.withColumn("pair", F.col("tri").bitwiseAND(F.lit(65535))).join(pairs, "pair").groupBy(F.shiftright("tri", 8).alias("context"))
    contexts = per.agg(F.sum("n2").alias("total"), F.count("*").alias("kinds"), F.sum("n1").alias("excluded")).toArrow()
    one, by = np.zeros(65536), {name: np.zeros(65536) for name in ("total", "kinds", "excluded")}
    got = pairs.toArrow()
    one[got.column("pair").to_numpy()] = got.column("n1").to_numpy()
    for name, table in by.items():
        table[contexts.column("context").to_numpy()] = contexts.column(name).to_numpy()
    return Short(one.reshape(256, 256).sum(0), one, **by)


def price(gram: np.ndarray, n: np.ndarray, n2: np.ndarray, short: Short) -> np.ndarray:
    """log2 probability of each of distinct grams; all that share three bytes of context must be there together."""
    size = len(gram)
    found, level = [], {}
    for k in range(ORDER, 2, -1):
        key, first, at = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_index=True, return_inverse=True)
        count = np.bincount(at, n, len(key))
        begin = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), (key[1:] >> 8) != (key[:-1] >> 8))))
        of = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [len(key)]))))
        level[k] = {"at": at, "count": count, "first": first, "begin": begin, "context": of[at], "total": np.add.reduceat(count, begin), "kinds": np.add.reduceat((count > 0).astype(float), begin)}
    for k in range(ORDER, 2, -1):
        x = level[k]
        lower = n2 if k == 3 else level[k - 1]["count"][level[k - 1]["at"]]
        excluded = np.add.reduceat(np.where(x["count"] > 0, lower[x["first"]], 0), x["begin"])
        if k == 3:
            context = gram >> 8 & 65535
            total, kinds = short.total[context], short.kinds[context]
        else:
            total, kinds = (level[k - 1][name][level[k - 1]["context"]] for name in ("total", "kinds"))
        c = x["context"]
        found.append((x["count"][x["at"]], x["total"][c], x["kinds"][c], total - excluded[c], kinds - x["kinds"][c]))
    for counts, bits, (total, kinds, rest, more) in zip((n2, short.one[gram & 65535], short.zero[gram & 255]), (65535, 255, 0), short.levels(), strict=True):
        context = gram >> 8 & bits
        found.append((counts, total[context], kinds[context], rest[context], more[context]))
    out, left = np.zeros(size), np.ones(size, bool)
    mass, escape = np.full(size, -1.0), np.zeros(size)  # of the current context, after exclusion; -1: none was known yet
    for count, total, kinds, rest, more in found:
        known = total > 0
        fresh = known & (mass < 0)
        mass, escape = np.where(fresh, total, mass), np.where(fresh, kinds, escape)
        hit = left & (count > 0) & (mass > 0)
        out[hit] += np.log2((2 * count[hit] - 1) / (2 * mass[hit]))
        left &= ~hit
        go = left & (mass > 0)
        out[go] += np.log2(escape[go] / (2 * mass[go]))
        passed = left & known
        mass, escape = np.where(passed, rest, mass), np.where(passed, more, escape)
    out[left] -= np.log2(max(256 - int((short.zero > 0).sum()), 1))
    return out


def priced(grams: DataFrame) -> DataFrame:
    """(gram, m, bits) from (gram, n, m), a written table: each distinct gram's log2 probability."""
    three = F.col("gram").bitwiseAND(F.lit((1 << 24) - 1))
    trigrams = materialize(grams.filter("n > 0").groupBy(three.alias("tri")).agg(F.sum("n").alias("n2")), "trigrams")
    shared = grams.sparkSession.sparkContext.broadcast(short_levels(trigrams))  # five arrays of fixed size

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            _, gram, n, m, n2 = np.concatenate(rows).T
            return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(m), pa.array(price(gram, n.astype(float), n2.astype(float), shared.value))], ["gram", "m", "bits"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([x.to_numpy() for x in batch.columns])
            held.append(rows)
            size += len(rows)
            if size >= _PRICED and held[0][0, 0] != rows[-1, 0]:  # all but the run that may go on
                whole = np.concatenate(held)
                cut = int(np.searchsorted(whole[:, 0], whole[-1, 0]))
                yield out([whole[:cut]])
                held, size = [whole[cut:]], len(whole) - cut
        if held:
            yield out(held)

    context = F.col("gram").bitwiseAND(F.lit((1 << 32) - 256)).alias("context")
    rows = grams.withColumn("tri", three).join(trigrams, "tri", "left").select(context, "gram", "n", "m", F.coalesce("n2", F.lit(0)).alias("n2"))
    return rows.repartition("context").sortWithinPartitions("context").mapInArrow(run, "gram long, m long, bits double")


class Lookup:
    """Bits of the commonest grams: one slot for each hash, its commonest gram in it, the others in a sorted table."""

    def __init__(self, gram: np.ndarray, bits: np.ndarray):
        """``gram`` rises in commonness."""
        self.shift = np.uint64(64 - max(10, (2 * len(gram)).bit_length()))
        self.key, self.bits = np.full(1 << (64 - int(self.shift)), -1, np.int64), np.zeros(1 << (64 - int(self.shift)))
        at = self._slot(gram)
        self.key[at] = gram  # of equal slots the last one stays
        mine = self.key[at] == gram
        self.bits[at[mine]] = bits[mine]
        order = np.argsort(gram[~mine])
        self.more, self.more_bits = gram[~mine][order], bits[~mine][order]

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram.astype(np.uint64) * _TIMES) >> self.shift

    def __call__(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits, 0 where unknown; places of the unknown ones)."""
        at = self._slot(gram)
        hit = self.key[at] == gram
        out = np.where(hit, self.bits[at], 0.0)
        left = np.flatnonzero(~hit)
        if len(self.more) and len(left):
            k = np.minimum(np.searchsorted(self.more, gram[left]), len(self.more) - 1)
            there = self.more[k] == gram[left]
            out[left[there]] = self.more_bits[k[there]]
            left = left[~there]
        return out, left


def _least_step(table: DataFrame, count: str, most: int, steps: int) -> int:
    """The least step of log2(count) * ``steps`` from which on at most ``most`` rows are left; few rows are looked at."""
    sizes = sorted(table.groupBy(F.floor(F.log2(count) * steps).alias("p")).count().collect(), reverse=True)
    least, total = (sizes[0][0] + 1 if sizes else 0), 0
    for step, size in sizes:
        total += size
        if total > most:
            break
        least = step
    return int(least)


def _split(table: DataFrame, count: str, most: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """(the commonest rows, at most ``most``; all others)."""
    common = F.floor(F.log2(count) * steps) >= _least_step(table, count, most, steps)
    return table.filter(common), table.filter(~common)


def _tallied(owner: np.ndarray, what: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ``what`` of each row, times, end of each row's part) from pairs."""
    order = np.lexsort((what, owner))
    owner, what = owner[order], what[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(what), 1), bool), (owner[1:] != owner[:-1]) | (what[1:] != what[:-1]))))
    return what[first], np.diff(np.concatenate((first, [len(what)]))), np.searchsorted(owner[first], np.arange(n_rows + 1))


_loaded: dict = {}


def _once_value(broadcast, make):
    """``make`` of a broadcast's value, once in a worker process."""
    value = broadcast.value
    if _loaded.get("of") is not value:
        _loaded.clear()
        _loaded.update(of=value, made=make(value))
    return _loaded["made"]


def scores(docs: DataFrame, modulus: int = 7, held_out: int = 2, top_words: int = 200_000, max_grams: int = 2_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learning uses the rows whose crc32(doc_id as text) modulo ``modulus`` is not ``held_out`` (a null id
    counts as empty text). A null or empty text is its end token alone. Repeated rows are each counted
    and scored. Without training rows every byte and word is new. Other columns are not read.
    ``top_words`` and ``max_grams`` bound what is broadcast; results do not depend on them.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (id_residue(F.col("doc_id"), modulus) == held_out).alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    common_grams, rare_grams = _split(materialize(priced(materialize(count_grams(rows), "grams")), "priced"), "m", max_grams, 4)
    words = materialize(count_words(training), "words")
    n_docs = training.select("doc_id").count()
    n_words, n_distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = int(n_words) + n_docs
    log_all = float(np.log10(n_train + n_distinct + (n_docs > 0) + 1))
    end_part, end_known = float(np.log10(n_docs + 1)), int(n_docs > 0)
    common_words, rare_words = _split(words, "c", top_words, 16)
    top, grams = common_words.toArrow(), common_grams.toArrow()  # bounded by top_words and max_grams
    order = np.argsort(grams.column("m").to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast((grams.column("gram").to_numpy()[order], grams.column("bits").to_numpy()[order], top.column("word").combine_chunks().cast(pa.large_string()), np.log10(top.column("c").to_numpy() + 1.0)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, top, logs = _once_value(shared, lambda x: (Lookup(x[0], x[1]), x[2], np.append(x[3], 0.0)))
        number = TaskContext.get().partitionId() << 40
        for batch in sized_slices(batches, 1, _BATCH):
            rows = batch.num_rows
            listed, n_words = split_words(batch.column(1))
            grams, sizes = scored_positions(listed)
            bits, new = lookup(grams)
            score = np.add.reduceat(bits, np.cumsum(sizes) - sizes) * np.log10(2.0)
            gram, gram_n, gram_ends = _tallied(np.repeat(np.arange(rows), sizes)[new], grams[new], rows)
            coded = listed.flatten().dictionary_encode()
            code, empty = coded.indices.to_numpy(), pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
            place = pc.fill_null(pc.index_in(coded.dictionary, top), -1).to_numpy(zero_copy_only=False)
            log, rare = logs[place], (place < 0) & ~empty
            begin, owner = listed.offsets.to_numpy()[:-1], np.repeat(np.arange(rows), np.diff(listed.offsets.to_numpy()))
            base = np.add.reduceat(log[code], begin)  # every text has an entry
            is_rare = rare[code]
            word, word_n, word_ends = _tallied(owner[is_rare], code[is_rare], rows)
            tokens = n_words + 1
            known = n_words - np.bincount(owner[is_rare], minlength=rows) + end_known
            of_words = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(word_n)], ["word", "n"])
            of_grams = pa.StructArray.from_arrays([pa.array(gram), pa.array(gram_n)], ["gram", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + rows)), batch.column(0), batch.column(2), pa.array(tokens), pa.array(known), pa.array(base + end_part - tokens * log_all), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(word_ends, pa.int32()), of_words), pa.ListArray.from_arrays(pa.array(gram_ends, pa.int32()), of_grams),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "grams"],
            )
            number += rows

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: string, n: long>>, grams array<struct<gram: long, n: long>>"
    first = materialize(rows.mapInArrow(run, schema), "scored")
    others = lambda name: first.select("row", F.explode(name).alias("x")).select("row", "x.*")
    # words that training does not have add log10(0 + 1) = 0 and are not known: an inner join is enough
    more = others("rare").join(rare_words, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"))
    more_bits = others("grams").join(rare_grams.select("gram", "bits"), "gram").groupBy("row").agg((F.sum(F.col("n") * F.col("bits")) * float(np.log10(2.0))).alias("more_score"))
    return first.drop("rare", "grams").join(more, "row", "left").join(more_bits, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
