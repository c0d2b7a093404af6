"""TF-IDF in relational form: (doc_id, term) tables instead of a sparse matrix.

Weighting: sublinear tf ``1 + ln(tf)`` times smoothed idf ``ln((1+N)/(1+df)) + 1``,
then L2 normalisation per document; N counts every document of both domains.
Vocabulary: terms with ``df >= min_df`` and ``df <= max_df * N`` (fractions) and the
``max_features`` terms with the largest corpus frequency among them.

Plan shape, in two passes over the documents. Counting: tasks sum the (term, df, tf) of their
documents' n-grams, those of a bounded number of words at a time; only these sums are shuffled, and the best
``max_features`` terms are kept. Weighting: that vocabulary, of bounded size, goes to the tasks; a
document's counts stay in its row as two arrays of numbers, from which the row
takes its norm, so no n-gram row is shuffled or stored. Several readers of the weights share the counts.
Without a bound on the vocabulary the weights come from a join and a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from contrasta.operators import tokens as tk
from contrasta.operators._util import with_scalar

SCORE_DIGITS = 12  # ranking ties are decided on rounded scores, then by term
# Largest vocabulary that is looked up within the rows, and words whose n-grams a task sums at a time.
MAX_ROW_VOCABULARY, MOST_WORDS = 20_000, 1_000_000


def _words(text_col: str, stop_words) -> Column:
    words = tk.english_stop_words() if stop_words is None else list(stop_words)
    found = tk.tfidf_tokens(text_col)
    return F.filter(found, lambda t: ~t.isin(*words)) if words else found


def _grams(text_col: str, stop_words, ngram_range) -> Column:
    return F.transform(F.array(_words(text_col, stop_words)), lambda x: tk.ngrams(x, *ngram_range))[0]  # binds the tokens


def _counted(grams: Column) -> Column:
    """Array of (term, tf) of an array of n-grams: sorted, then counted by the places where runs start."""
    def runs(x: Column) -> Column:
        def starts(i: Column) -> Column:
            return (i == 0) | (F.get(x, i) != F.get(x, i - 1))
        def each(at: Column) -> Column:
            return F.transform(at, lambda a, k: F.struct(F.get(x, a).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(x)) - a).cast("long").alias("tf")))
        at = F.when(F.size(x) > 0, F.filter(F.sequence(F.lit(0), F.size(x) - 1), starts))
        return F.transform(F.array(at), each)[0]
    return F.transform(F.array(F.sort_array(grams)), runs)[0]


def term_frequencies(docs: DataFrame, text_col: str = "text_lemma", stop_words=None,
                     ngram_range=(1, 2)) -> DataFrame:
    """``(doc_id, domain, term, tf)`` for every n-gram of every document; counted within the row."""
    counted = tk.computed_once(docs.select("doc_id", "domain", text_col), _counted(_grams(text_col, stop_words, ngram_range)), "_terms")
    return counted.select("doc_id", "domain", F.inline("_terms"))


def _words_fn(stop_words):
    """Function of an array of lower-cased texts: text and number of each word that is no stop word, and the distinct words.

    Matches of ``[a-zA-Z]{2,}`` are found in the bytes: UTF-8 has no ASCII letter within other characters. Words are looked
    up by their numbers, each distinct one once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    letters = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
    stops = pa.array(tk.english_stop_words() if stop_words is None else list(stop_words), pa.string())

    def found(texts):
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        letter = letters[data]
        opens, closes = letter.copy(), letter.copy()
        opens[1:] &= ~letter[:-1]
        closes[:-1] &= ~letter[1:]
        at = bounds[:-1][bounds[:-1] < len(data)]  # no word goes on in the next text
        opens[at] = letter[at]
        at = bounds[1:][bounds[1:] > 0] - 1
        closes[at] = letter[at]
        starts = np.flatnonzero(opens)
        sizes = np.flatnonzero(closes) + 1 - starts
        letter[starts[sizes < 2]] = False
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[letter])).dictionary_encode()
        numbers, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))
        kept = ~pc.is_in(names, value_set=stops).to_numpy(zero_copy_only=False)
        more = kept[numbers]
        return doc[more], (np.cumsum(kept) - 1)[numbers[more]], names.filter(pa.array(kept))
    return found


def _parts(texts, most: int):
    """Places of the first and behind the last text of each part of about ``most`` words (of 8 bytes)."""
    import numpy as np
    import pyarrow.compute as pc
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // (8 * most)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    return zip(starts, [*starts[1:], len(texts)])


def _lowered(text_col: str) -> Column:
    return F.lower(F.coalesce(F.col(text_col), F.lit("")))


def _sums_fn(ngram_range, most: int, stop_words=None):
    """Per-task sums ``(term, df, tf)`` of the n-grams of lower-cased texts, of about ``most`` words at a time.

    Words become numbers; the number of an n-gram is made of that of its first n-1 words and that of the last."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    def sums(words):
        doc, last, names = words
        at, ids, terms = np.arange(len(last)), last, names
        for n in range(1, ngram_range[1] + 1):
            if n > 1:  # n-grams start where those of n-1 words do, if the text goes on
                more = at + n - 1 < len(last)
                at, ids = at[more], ids[more]
                more = doc[at] == doc[at + n - 1]
                at, ids = at[more], ids[more]
                ids, found = pd.factorize(ids * len(names) + last[at + n - 1])
                terms = pc.binary_join_element_wise(terms.take(pa.array(found // max(len(names), 1))), names.take(pa.array(found % max(len(names), 1))), " ")
            if n >= ngram_range[0] and len(terms):
                df = np.bincount(pd.unique(doc[at] * len(terms) + ids) % len(terms), minlength=len(terms))
                yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(np.bincount(ids, minlength=len(terms)), pa.int64())], ["term", "df", "tf"])

    def each(batches):
        words = _words_fn(stop_words)
        for batch in batches:
            texts = batch.column(0)
            for i, j in _parts(texts, most):
                yield from sums(words(texts.slice(i, j - i)))
    return each


def term_sums(docs: DataFrame, text_col: str = "text_lemma", stop_words=None, ngram_range=(1, 2), most: int = MOST_WORDS) -> DataFrame:
    """``(term, df, total_tf)`` of all documents, summed within the tasks before the shuffle."""
    part = docs.select(_lowered(text_col).alias("_text")).mapInArrow(_sums_fn(tuple(ngram_range), most, stop_words), "term string, df long, tf long")
    return part.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total_tf"))


def _counts_fn(names: list[str], ngram_range, most: int, stop_words=None):
    """Rows ``(doc_id, domain, text)`` to ``(doc_id, domain, _ats, _tfs)``: places in ``names`` of the text's n-grams, ascending, and tf.

    An n-gram is found by the place of its first n-1 words among the beginnings of the vocabulary's terms and its last word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def beginnings():
        """Distinct words of the vocabulary; for each length the sorted keys of beginnings and their places in ``names`` (or -1)."""
        grams = [tuple(x.split(" ")) for x in names]
        words = sorted({w for g in grams for w in g})
        number, before, levels = {w: i for i, w in enumerate(words)}, {(): 0}, []
        for n in range(1, ngram_range[1] + 1):
            key = {g[:n]: before[g[:n - 1]] * len(words) + number[g[n - 1]] for g in grams if len(g) >= n}
            before = {g: i for i, g in enumerate(sorted(key, key=key.get))}
            place = np.full(len(before), -1, np.int64)
            for i, g in enumerate(grams):
                if len(g) == n >= ngram_range[0]:
                    place[before[g]] = i
            levels.append((np.array(sorted(key.values()), np.int64), place))
        return pa.array(words, pa.string()), levels

    def counts(texts, words, known, levels):
        doc, last, own = words(texts)
        last = pc.fill_null(pc.index_in(own, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[last]
        at, ids, hits = np.arange(len(last)), np.zeros(len(last), np.int64), [np.zeros(0, np.int64)]
        for n, (keys, place) in enumerate(levels, 1):
            if not len(keys):
                break
            more = at + n - 1 < len(last)
            at, ids = at[more], ids[more]
            more = (doc[at] == doc[at + n - 1]) & (last[at + n - 1] >= 0)
            at, ids = at[more], ids[more]
            key = ids * len(known) + last[at + n - 1]
            ids = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            more = keys[ids] == key
            at, ids = at[more], ids[more]
            more = place[ids] >= 0
            hits.append(doc[at[more]] * len(names) + place[ids[more]])
        found, tf = np.unique(np.concatenate(hits), return_counts=True)
        ends = pa.array(np.searchsorted(found, np.arange(len(texts) + 1) * len(names)), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found % max(len(names), 1), tf)]

    def each(batches):
        words, (known, levels) = _words_fn(stop_words), beginnings()
        for batch in batches:
            for i, j in _parts(batch.column(2), most):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *counts(part.column(2), words, known, levels)], ["doc_id", "domain", "_ats", "_tfs"])
    return each


def domain_sizes(docs: DataFrame) -> DataFrame:
    """``(domain, n_domain, n_docs)``: documents per domain and in the whole corpus."""
    per = docs.groupBy("domain").agg(F.count(F.lit(1)).alias("n_domain"))
    return per.withColumn("n_docs", F.sum("n_domain").over(Window.partitionBy()))


def vocabulary(tf: DataFrame, sizes: DataFrame, min_df=5, max_df=0.95,
               max_features: int | None = 5000) -> DataFrame:
    """``(term, df, idf)`` for the kept vocabulary."""
    sums = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    return kept_terms(sums, sizes, min_df, max_df, max_features)


def kept_terms(sums: DataFrame, sizes: DataFrame, min_df=5, max_df=0.95,
               max_features: int | None = 5000) -> DataFrame:
    """``vocabulary`` from the sums ``(term, df, total_tf)``."""
    n = sizes.agg(F.sum("n_domain").alias("n_docs"))
    stats = with_scalar(sums, n)
    lo = F.lit(min_df) if isinstance(min_df, int) else F.lit(min_df) * F.col("n_docs")
    hi = F.lit(max_df) if isinstance(max_df, int) else F.lit(max_df) * F.col("n_docs")
    kept = stats.where((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features is not None:
        kept = kept.orderBy(F.desc("total_tf"), F.asc("term")).limit(max_features)
    idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    return kept.select("term", "df", idf.alias("idf"))


def tfidf_weights(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc_id, domain, term, tf, score)``: L2-normalised sublinear TF-IDF, for vocabularies of any size."""
    w = tf.join(vocab, "term").withColumn("w", (1.0 + F.log(F.col("tf"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "domain", "term", "tf", (F.col("w") / norm).alias("score"))


def row_weights(docs: DataFrame, vocab: DataFrame, text_col: str = "text_lemma", stop_words=None,
                ngram_range=(1, 2), materialize=None) -> DataFrame:
    """``tfidf_weights`` for a vocabulary of bounded size: no shuffle of documents or n-grams.

    ``materialize`` is applied to the documents' counts (places in the vocabulary and tf as arrays), which
    every reader of the weights then shares."""
    names = sorted(r.term for r in vocab.select("term").collect())  # at most MAX_ROW_VOCABULARY
    table = vocab.agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("_vocab"))  # in the same order
    d = docs.select("doc_id", "domain", _lowered(text_col).alias("_text"))
    counted = StructType([*d.schema.fields[:2], *[StructField(c, ArrayType(IntegerType())) for c in ("_ats", "_tfs")]])
    d = d.mapInArrow(_counts_fn(names, tuple(ngram_range), MOST_WORDS, stop_words), counted)
    d = materialize(d) if materialize is not None else d

    def weight(at: Column, tf: Column) -> Column:
        known = F.get("_vocab", at)
        return F.struct(known["term"].alias("term"), tf.cast("long").alias("tf"), ((1.0 + F.log(tf)) * known["idf"]).alias("w"))

    d = tk.computed_once(with_scalar(d, table), F.zip_with("_ats", "_tfs", weight), "_terms").select("doc_id", "domain", "_terms")
    norm = F.sqrt(F.aggregate("_terms", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    d = d.select("doc_id", "domain", "_terms", norm.alias("_norm")).select("doc_id", "domain", "_norm", F.inline("_terms"))
    return d.select("doc_id", "domain", "term", "tf", (F.col("w") / F.col("_norm")).alias("score"))


def mean_scores(weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(domain, term, mean_tfidf)``: mean over all documents of the domain (zeros included)."""
    sums = weights.groupBy("domain", "term").agg(F.sum("score").alias("_sum"))
    return (sums.join(F.broadcast(sizes.select("domain", "n_domain")), "domain")
            .select("domain", "term", (F.col("_sum") / F.col("n_domain")).alias("mean_tfidf")))


def top_n_per_domain(means: DataFrame, top_n: int = 25) -> DataFrame:
    """``(domain, rank, term, mean_tfidf)``: best ``top_n`` terms per domain."""
    w = Window.partitionBy("domain").orderBy(F.desc(F.round("mean_tfidf", SCORE_DIGITS)), F.asc("term"))
    return (means.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_n)
            .select("domain", "rank", "term", "mean_tfidf"))


def fit(docs: DataFrame, text_col: str = "text_lemma", max_features: int | None = 5000,
        ngram_range=(1, 2), min_df=5, max_df=0.95, stop_words=None, materialize=None, reused: bool = False):
    """Vectoriser fit over both domains: returns ``(tf, sizes, vocab, weights)``.

    ``materialize`` (e.g. a checkpoint) is applied to a bounded vocabulary, which every reader of
    the weights needs, and to the documents' counts if the weights are ``reused``."""
    tf = term_frequencies(docs, text_col, stop_words, ngram_range)
    sizes = domain_sizes(docs)
    vocab = kept_terms(term_sums(docs, text_col, stop_words, ngram_range), sizes, min_df, max_df, max_features)
    if max_features is None or max_features > MAX_ROW_VOCABULARY:
        return tf, sizes, vocab, tfidf_weights(tf, vocab)
    vocab = materialize(vocab) if materialize is not None else vocab
    return tf, sizes, vocab, row_weights(docs, vocab, text_col, stop_words, ngram_range, materialize if reused else None)


def top_terms_per_domain(docs: DataFrame, top_n: int = 25, **kw) -> DataFrame:
    """Top ``top_n`` terms by mean TF-IDF for every domain of ``docs``."""
    _, sizes, _, weights = fit(docs, **kw)
    return top_n_per_domain(mean_scores(weights, sizes), top_n)
