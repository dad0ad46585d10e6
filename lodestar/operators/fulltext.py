"""Inverted text index and free-text ranking.

Words are lower-cased and split on anything that is not a letter, digit or
underscore ("neutral" word breaking: only exact word forms match). Stop words
are neither indexed nor matched. The index is a postings table
``term, id, tf, df, weight`` where ``weight`` is the BM25 impact of the term in
that row, so a query is one equi-join on ``term`` plus a sum per (question, row).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.config import BM25_B, BM25_K1, DIST_DIGITS, ICELANDIC_STOPWORDS, TOKEN_SPLIT
from lodestar.session import scratch_path

BROADCAST_BYTES = 16 << 20
WORDS_AT_ONCE = 1 << 20       # words of texts, or postings, that a task counts at a time
HITS_AT_ONCE = 4 << 20        # pairs of a posting and a question that a task adds up at a time


def stopword_table(spark: SparkSession, words: str = ICELANDIC_STOPWORDS, language: str = "is") -> DataFrame:
    """The stop list as a table (one row per word), split from its text form."""
    return (spark.createDataFrame([(language, words)], "language string, words string")
            .select("language", F.explode(F.split("words", " ")).alias("term"))
            .where(F.col("term") != "").distinct())


def terms(text: Column) -> Column:
    """Lower-cased words of a text as an array (empty strings removed)."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def tokens(df: DataFrame, id: str, text: str, stopwords: DataFrame | None) -> DataFrame:
    out = df.select(F.col(id).alias("id"), F.explode(terms(F.col(text))).alias("term"))
    if stopwords is not None:
        # The stop list is a fixed, small table: broadcasting it is size-bounded.
        out = out.join(F.broadcast(stopwords.select("term").distinct()), "term", "left_anti")
    return out


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for broadcast if its counted rows fit ``BROADCAST_BYTES``, else for a shuffled join."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: columns that a reader does not ask for stay on disk."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def term_counts(docs: DataFrame, *, id: str = "id", text: str = "content", stopwords: DataFrame | None = None,
                keep: bool = True) -> DataFrame:
    """``term, id, tf, dl`` for every word (stop words included), tokenised once; ``dl`` is the row's number of words
    without stop words.

    Texts are dealt by id once, in the order of their ids, and words are counted where the text lies: no (word, row) pair is
    shuffled. The result is stored: the index build reads the text once, and lineage is cut."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).repartition("id").sortWithinPartitions("id")
    rows = rows.select("id", terms(F.col("text")).alias("words"))
    stop = [r.term for r in stopwords.select("term").distinct().collect()] if stopwords is not None else []  # a fixed, small list
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema["id"], T.StructField("tf", T.LongType()),
                           T.StructField("dl", T.LongType())])
    tf = rows.mapInArrow(_counted(stop), schema)
    return stored(tf, "term_counts") if keep else tf


def _runs(ids: pa.Array) -> np.ndarray:
    """Where another id begins, in a column that has equal ids side by side."""
    code = ids.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(np.diff(code)) + 1] if len(code) else np.zeros(0, np.int64)


def _counted(stop: list[str]):
    """Counts the words of rows ``id, words`` that come in the order of their ids: ``term, id, tf, dl``."""
    def run(batches):
        left_out = pa.array(stop, pa.string())
        held: tuple | None = None  # the last id: its rows may go on in the next batch

        def batch(ids, terms_, tf, dl):
            return pa.RecordBatch.from_arrays([terms_, ids, pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], names=["term", "id", "tf", "dl"])

        def closed():
            key, counts, dl = held
            n = len(counts)
            return batch(pa.repeat(key, n), pa.array(list(counts), pa.string()), list(counts.values()), [dl] * n)

        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + WORDS_AT_ONCE, "right")))
                part, lo = b.slice(lo, hi - lo), hi
                ids, words = part.column("id"), part.column("words")
                first = _runs(ids)
                row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
                own = np.repeat(row, pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
                coded = words.flatten().dictionary_encode()
                code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
                counts_to = ~pc.is_in(coded.dictionary, value_set=left_out).to_numpy(zero_copy_only=False)
                dl = np.bincount(own, weights=counts_to[code], minlength=len(first)).astype(np.int64)
                pair, tf = np.unique(own * size + code, return_counts=True)
                at, word = pair // size, pair % size
                begin = 0
                if held is not None and ids[0].as_py() == held[0].as_py():  # the id of before goes on
                    begin = int(np.searchsorted(at, 1))
                    for w, n in zip(coded.dictionary.take(pa.array(word[:begin])).to_pylist(), tf[:begin].tolist()):
                        held[1][w] = held[1].get(w, 0) + n
                    held = (held[0], held[1], held[2] + int(dl[0]))
                    if len(first) == 1:
                        continue
                if held is not None and held[1]:
                    yield closed()
                end = int(np.searchsorted(at, len(first) - 1))
                if end > begin:
                    keep = at[begin:end]
                    yield batch(ids.take(pa.array(first[keep])), coded.dictionary.take(pa.array(word[begin:end])), tf[begin:end], dl[keep])
                last = dict(zip(coded.dictionary.take(pa.array(word[end:])).to_pylist(), tf[end:].tolist()))
                held = (ids[int(first[-1])], last, int(dl[-1]))
        if held is not None and held[1]:
            yield closed()
    return run


def document_frequencies(counts: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """``term, df, cf``: in how many rows each word stands and how often (stop words left out), stored."""
    if stopwords is not None:
        counts = counts.join(F.broadcast(stopwords.select("term").distinct()), "term", "left_anti")
    return stored(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "document_frequencies")


def build_postings(docs: DataFrame, *, id: str = "id", text: str = "content",
                   stopwords: DataFrame | None = None, k1: float = BM25_K1, b: float = BM25_B,
                   counts: DataFrame | None = None, frequencies: DataFrame | None = None,
                   words: DataFrame | None = None) -> DataFrame:
    """Postings with BM25 impact weights (stop words left out).

    ``counts`` and ``frequencies`` may pass ``term_counts`` (with the same stop words) and ``document_frequencies`` made
    before. With ``words`` (``term``) only the lists of these words are opened, their weights being those of the whole."""
    tf = counts if counts is not None else term_counts(docs, id=id, text=text, stopwords=stopwords)
    df = frequencies if frequencies is not None else document_frequencies(tf, stopwords)
    n_docs, total = float(docs.count()), df.agg(F.sum("cf")).first()[0]
    avgdl = F.lit(total / n_docs if total else None).cast("double")
    df = df.select("term", "df")
    if words is not None:
        words = words.select("term").distinct()
        df = small(stored(df.join(small(words, 32), "term", "left_semi"), "words"), 48)
    # joined with the frequencies, stop words have none and go
    idf = F.log(F.lit(1.0) + (F.lit(n_docs) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    weight = idf * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)
    return tf.where("id is not null").join(df, "term").select("term", "id", "tf", "df", weight.alias("weight"))


def query_terms(questions: DataFrame, *, qid: str = "qid", text: str = "question",
                stopwords: DataFrame | None = None) -> DataFrame:
    """Distinct non-stop words of each question: ``qid, term``."""
    return tokens(questions, qid, text, stopwords).withColumnRenamed("id", "qid").distinct()


def _scored(qt: DataFrame, postings: DataFrame, exclude_self: bool, digits: int) -> DataFrame:
    """``qid, id, relevance`` of every row with a word of the question. Postings are dealt by id and meet the question words where
    they lie, so the pairs of a question and a row are added up in place: what is shuffled is each posting once."""
    hits = postings.select("term", "id", "weight").repartition("id").join(small(qt, 48), "term")
    if exclude_self:
        hits = hits.where(F.col("qid") != F.col("id"))
    return (hits.groupBy("qid", "id").agg(F.sum("weight").alias("_s"))
            .select("qid", "id", (F.round("_s", digits) + F.lit(0.0)).alias("relevance")))


def _top_scored(qt: DataFrame, postings: DataFrame, k: int, exclude_self: bool, digits: int) -> DataFrame:
    """Top-k of ``_scored``: ``qid, id, relevance, rank``. Question words within ``BROADCAST_BYTES`` are sent to where the postings of an
    id lie; a task adds up its ids one slice at a time and keeps the best ``k`` rows of each question, so neither the pairs of a
    question and a posting nor those of a question and a row become rows."""
    from lodestar.operators.knn import top_k_per_query

    most = BROADCAST_BYTES // 48
    asked = qt.select("qid", "term").limit(most + 1).toArrow()  # bounded
    if asked.num_rows > most or not isinstance(postings.schema["id"].dataType, T.LongType | T.IntegerType):
        return top_k_per_query(_scored(qt, postings, exclude_self, digits), k, "relevance", descending=True)
    spark = postings.sparkSession
    qids = asked["qid"].combine_chunks().dictionary_encode("encode")
    words = asked["term"].combine_chunks().dictionary_encode()
    by = np.argsort(words.indices.to_numpy(zero_copy_only=False), kind="stable")
    whose = qids.indices.to_numpy(zero_copy_only=False).astype(np.int64)[by]
    lists = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
    coded = pa.table([words.dictionary, pa.array(np.arange(len(words.dictionary)), pa.int32())], names=["term", "word"])
    coded = spark.createDataFrame(coded.to_pylist(), "term string, word int")
    sent = spark.sparkContext.broadcast((qids.dictionary, whose, lists, np.cumsum(lists) - lists))
    schema = T.StructType([qt.schema["qid"], postings.schema["id"], T.StructField("_s", T.DoubleType())])

    def best(batches):
        names, whose, lists, begin = sent.value
        nq = len(names)
        least = np.full(nq, -np.inf)
        out, found, held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        rest = None  # postings of the last id: more may follow

        def fold():
            nonlocal out, found, held
            q, i, s = (np.concatenate([out[c], *[f[c] for f in found]]) for c in range(3))
            r = np.round(s, digits)
            o = np.lexsort((i, -r, q))
            q, i, s, r = q[o], i[o], s[o], r[o]
            first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            least[q[place == k - 1]] = r[place == k - 1]
            keep = place < k
            out, found, held = (q[keep], i[keep], s[keep]), [], 0

        def add(t):
            nonlocal held
            ids, word, weight = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "word", "weight"))
            starts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1]
            hits = np.cumsum(lists[word])
            before = np.r_[0, hits][starts]
            a = 0
            while a < len(starts):  # whole ids, of about ``HITS_AT_ONCE`` hits
                z = max(a + 1, int(np.searchsorted(before, before[a] + HITS_AT_ONCE, "left")))
                lo, hi = starts[a], starts[z] if z < len(starts) else len(ids)
                n = lists[word[lo:hi]]
                total = int(n.sum())
                at = np.arange(total) - np.repeat(np.cumsum(n) - n - begin[word[lo:hi]], n)
                run = np.searchsorted(starts[a:z], np.arange(lo, hi), "right") - 1
                key = np.repeat(run, n) * nq + whose[at]
                w = np.repeat(weight[lo:hi], n)
                if (z - a) * nq <= 4 * total:
                    s, pair = np.bincount(key, w), np.flatnonzero(np.bincount(key))
                    s = s[pair]
                else:
                    pair, to = np.unique(key, return_inverse=True)
                    s = np.bincount(to, w, minlength=len(pair))
                q, i = pair % nq, ids[starts[a:z]][pair // nq]
                keep = np.round(s, digits) >= least[q]
                if exclude_self:
                    own = pc.fill_null(pc.index_in(pa.array(ids[starts[a:z]]), value_set=names.cast(pa.int64())), -1)
                    keep &= (own.to_numpy(zero_copy_only=False)[pair // nq] != q) & names.is_valid().to_numpy(zero_copy_only=False)[q]
                found.append((q[keep], i[keep], s[keep]))
                held += int(keep.sum())
                if held > HITS_AT_ONCE // 4:
                    fold()
                a = z

        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            if not t.num_rows:
                continue
            ids = t.column("id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1], "left"))
            if cut:
                add(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            add(rest)
        if found or len(out[0]):
            fold()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(out[0])), pa.array(out[1]).cast(kind), pa.array(out[2])], names=["qid", "id", "_s"])

    kind = pa.int64() if isinstance(postings.schema["id"].dataType, T.LongType) else pa.int32()
    hits = postings.where("id is not null").join(F.broadcast(coded), "term").select("id", "word", "weight")
    found = hits.repartition("id").sortWithinPartitions("id").mapInArrow(best, schema)
    found = found.select("qid", "id", (F.round("_s", digits) + F.lit(0.0)).alias("relevance"))
    return top_k_per_query(found, k, "relevance", descending=True)


def fulltext_scores(questions: DataFrame, postings: DataFrame, *, qid: str = "qid", text: str = "question",
                    stopwords: DataFrame | None = None, digits: int = DIST_DIGITS) -> DataFrame:
    """BM25 relevance of every row that holds at least one query word: ``qid, id, relevance``."""
    return _scored(query_terms(questions, qid=qid, text=text, stopwords=stopwords), postings, False, digits)


def term_bitmaps(postings: DataFrame) -> DataFrame:
    """Each word's rows as bitmaps: ``term, bucket, bm`` (32,768 row ids per bucket). Row numbers are shuffled, not bitmaps of 4 KB
    from every partition."""
    return (postings.select("term", F.bitmap_bucket_number("id").alias("bucket"),
                            F.bitmap_bit_position("id").alias("pos"))
            .repartition("term", "bucket").groupBy("term", "bucket").agg(F.bitmap_construct_agg("pos").alias("bm")))


def match_count(questions: DataFrame, postings: DataFrame, *, qid: str = "qid", text: str = "question",
                stopwords: DataFrame | None = None, bitmaps: DataFrame | None = None) -> DataFrame:
    """How many rows match any word of each question (0 when all its words are stop words).

    Exact, without listing (question, row) pairs: the bitmaps of a question's words are
    OR-ed per bucket and their bits counted, so a word found in every row costs one
    row per 32,768 rows."""
    qt = query_terms(questions, qid=qid, text=text, stopwords=stopwords)
    if bitmaps is None:  # of the questions' words only
        bitmaps = term_bitmaps(postings.join(small(qt.select("term").distinct(), 32), "term", "left_semi"))
    per_bucket = small(qt, 48).join(bitmaps, "term").groupBy("qid", "bucket").agg(F.bitmap_or_agg("bm").alias("bm"))
    counts = per_bucket.groupBy("qid").agg(F.sum(F.bitmap_count("bm")).alias("matches"))
    return (questions.select(F.col(qid).alias("qid")).distinct()
            .join(counts, "qid", "left")
            .select("qid", F.coalesce("matches", F.lit(0)).cast("long").alias("matches")))


def missing_stopwords(spark: SparkSession, existing: DataFrame, words: str = ICELANDIC_STOPWORDS) -> DataFrame:
    """Words of the list that the stop table does not hold yet (binary comparison)."""
    wanted = stopword_table(spark, words).select("term")
    return wanted.join(existing.select("term").distinct(), "term", "left_anti")


def term_stats(postings: DataFrame) -> DataFrame:
    """The vocabulary: ``term, df, maxw`` (largest weight of the word in any row); built with the index."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("maxw"))


def text_top_k(questions: DataFrame, postings: DataFrame, k: int, *, qid: str = "qid", text: str = "question",
               stopwords: DataFrame | None = None, exclude_self: bool = False, common_df: int | None = None,
               digits: int = DIST_DIGITS, stats: DataFrame | None = None) -> DataFrame:
    """Exact BM25 top-k per question: ``qid, id, relevance, rank``.

    Without ``common_df`` every row with a word of the question is scored, in place (``_top_scored``).

    With it, words with at most ``common_df`` postings are *rare*: only they produce candidate
    rows, so each (question, word) expands to a bounded number of rows. Common words
    are then added for those candidates only (an equi-join on ``(term, id)``). A row
    that holds none of a question's rare words scores at most U = Σ max weight of its
    common words; when U is below the question's k-th candidate score the candidates'
    top-k is the true top-k. Questions where it is not (or with fewer than k
    candidates) are scored exhaustively — so the result is always exact."""
    from lodestar.operators.knn import top_k_per_query

    qt = query_terms(questions, qid=qid, text=text, stopwords=stopwords)
    if common_df is None:
        return _top_scored(qt, postings, k, exclude_self, digits)

    qt = qt.checkpoint()  # the words of the questions
    p = postings.select("term", "id", "weight").join(small(qt.select("term").distinct(), 32), "term", "left_semi")
    p = stored(p, "question_postings")  # read by every pass
    stats = stats if stats is not None else term_stats(p)
    qts = qt.join(stats, "term").checkpoint()
    rare = qts.where(F.col("df") <= common_df).select("qid", "term")
    common = qts.where(F.col("df") > common_df).select("qid", "term", "maxw")

    # pass 1: candidates from rare words, completed with their common words
    cand = p.join(small(rare, 48), "term")
    if exclude_self:
        cand = cand.where(F.col("qid") != F.col("id"))
    cand = cand.groupBy("qid", "id").agg(F.sum("weight").alias("_r")).checkpoint()
    near = p.join(small(cand.select("id").distinct(), 16), "id", "left_semi")
    extra = (cand.select("qid", "id").join(small(common.select("qid", "term"), 48), "qid")
             .join(near, ["term", "id"]).groupBy("qid", "id").agg(F.sum("weight").alias("_c")))
    full = (cand.join(extra, ["qid", "id"], "left")
            .select("qid", "id", (F.round(F.col("_r") + F.coalesce("_c", F.lit(0.0)), digits) + F.lit(0.0))
                    .alias("relevance")))
    # Questions × k rows, read three times below: written once to the shared checkpoint folder.
    top = top_k_per_query(full, k, "relevance", descending=True).checkpoint()

    # which questions the bound does not settle
    bound = common.groupBy("qid").agg(F.sum("maxw").alias("_u"))
    kth = top.groupBy("qid").agg(F.min("relevance").alias("_t"), F.count(F.lit(1)).alias("_n"))
    open_q = (bound.join(kth, "qid", "left")
              .where(F.col("_n").isNull() | (F.col("_n") < k) | (F.col("_u") + F.lit(10.0 ** -digits) >= F.col("_t")))
              .select("qid")).checkpoint()
    if open_q.limit(1).count() == 0:
        return top
    settled = top.join(open_q, "qid", "left_anti")
    # pass 2: exhaustive scoring for the open questions only
    return settled.unionByName(_top_scored(qt.join(open_q, "qid", "left_semi"), p, k, exclude_self, digits))
