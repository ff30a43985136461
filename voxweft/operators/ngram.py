"""N-gram language models as tables.

A model is a table of counts (n, ngram, ctx, word, c), where ``ngram`` and ``ctx`` are words joined by a space; it is written
when it is trained, so no query counts again. Backoff by counts needs two joins at any order: a second table holds each
n-gram's own probability and that of what was never seen after it. Interpolation takes two joins for each order. All are
on n-grams' texts, so neither side is held by one machine, and only different n-grams are joined with the model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..saved import saved

#: The marks of sentence ends and of unknown words.
BOS, EOS, UNK = "<s>", "</s>", "<unk>"
#: Between the words of an n-gram whose words may be unknown, and may hold spaces.
UNIT = "\x1f"
FLOOR = 1e-12
#: A mass of less than this is what rounding leaves of none.
NOTHING = 1e-9


@dataclass
class Model:
    order: int
    counts: DataFrame
    #: Rows (n, ngram, logp, bow) where the model was read from, or exported as, a backoff table.
    arpa: DataFrame | None = None
    #: What has been computed of the counts, by name.
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def of(self, n: int) -> DataFrame:
        return self.counts.filter(F.col("n") == n)

    def total(self) -> int:
        """All unigrams, sentence marks included."""
        if "total" not in self.known:
            self.known["total"] = self.of(1).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t")).first()["t"]
        return self.known["total"]

    def shares(self) -> DataFrame:
        """(n, ngram, p, rest), written once: the share a seen n-gram has of its context (a word, of all words), and the
        probability of whatever was never seen after it: what its continuations leave of it, times p; where they leave
        nothing, a uniform one. An n-gram whose context has no count has all of it."""
        if "shares" not in self.known:
            total = self.total()
            words, longer = self.counts.filter("n = 1"), self.counts.filter("n > 1")
            of_ctx = self.counts.select((F.col("n") + 1).alias("n"), F.col("ngram").alias("ctx"), F.col("c").alias("cc"))
            t = longer.join(of_ctx, ["n", "ctx"], "left").select("n", "ngram", "c", (F.col("c") / F.coalesce("cc", "c")).alias("p"))
            t = words.select("n", "ngram", "c", (F.col("c") / F.lit(total)).alias("p")).unionByName(t)
            followed = longer.groupBy((F.col("n") - 1).alias("n"), F.col("ctx").alias("ngram")).agg(F.sum("c").alias("observed"))
            left = F.col("c") - F.coalesce("observed", F.lit(0))
            rest = F.when(left > 0, left / F.col("c") * F.col("p")).otherwise(1.0 / (total + 1))
            self.known["shares"] = saved(t.join(followed, ["n", "ngram"], "left").select("n", "ngram", "p", rest.alias("rest")), "shares")
        return self.known["shares"]

    def shares_of(self, n: int) -> DataFrame:
        return self.shares().filter(F.col("n") == n)

    def vocabulary(self) -> DataFrame:
        """(word): words of the model, marks included."""
        marks = self.counts.sparkSession.createDataFrame([(m,) for m in (BOS, EOS, UNK)], "word string")
        return self.of(1).select("word").unionByName(marks).distinct()


def padded(tokens: Column, order: int, start: str = BOS) -> Column:
    return F.concat(F.array_repeat(F.lit(start), order - 1), tokens, F.array(F.lit(EOS)))


def grams(sequence: Column, n: Column | int, between: str = " ") -> Column:
    """All n-grams of a sequence, as texts; none if it is shorter. Each refers to the sequence, so that should be a column
    of the table and not an expression, which would be evaluated for each."""
    last = F.size(sequence) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(sequence, i, n), between))).otherwise(F.array().cast("array<string>"))


def context(ngram: Column) -> Column:
    """Without the last word; empty for a single word."""
    return F.substring(ngram, F.lit(1), F.char_length(ngram) - F.char_length(last_word(ngram)) - 1)


def suffix(ngram: Column) -> Column:
    """Without the first word; empty for a single word."""
    space = F.instr(ngram, " ")
    return F.when(space > 0, F.substring(ngram, space + 1, F.char_length(ngram))).otherwise("")


def last_word(ngram: Column) -> Column:
    return F.substring_index(ngram, " ", -1)


def train(sentences: DataFrame, order: int, tokens: str = "tokens") -> Model:
    """Counts of all 1- to order-grams of padded sentences, summed on the mappers first."""
    orders = F.explode(F.array(*[F.lit(n) for n in range(1, order + 1)]))
    sequences = sentences.select(padded(F.col(tokens), order).alias("sequence"), orders.alias("n"))
    counts = sequences.select("n", F.explode(grams(F.col("sequence"), F.col("n"))).alias("ngram")).groupBy("n", "ngram").agg(F.count("*").alias("c"))
    return Model(order, saved(counts.withColumns({"ctx": context(F.col("ngram")), "word": last_word(F.col("ngram"))}), "ngrams"))


def prune(model: Model, min_count: int) -> Model:
    """Without n-grams of two words or more that are rarer; single words stay."""
    return Model(model.order, model.counts.filter((F.col("n") == 1) | (F.col("c") >= min_count)))


def positions(sentences: DataFrame, order: int, keys: Sequence[str] = (), tokens: str = "tokens", start: str = BOS) -> DataFrame:
    """(keys, asked): the n-gram that ends at each position of padded sentences, words apart by ``UNIT``; none of empty ones."""
    # no filter on tokens, which Spark would make, with all that the tokens come from, a second time before the column
    t = sentences.select(*keys, F.when(F.size(tokens) > 0, padded(F.col(tokens), order, start)).alias("sequence"))
    return t.select(*keys, F.explode(grams(F.col("sequence"), order, UNIT)).alias("asked"))


def readable(asked: DataFrame, model: Model) -> DataFrame:
    """(asked, ngram) of the different n-grams of a table: the same with a space between words, and words that the model
    doesn't know replaced. Words are looked up only of n-grams that the model hasn't counted."""
    t = asked.select("asked").distinct().withColumn("ngram", F.translate("asked", UNIT, " "))
    counted = model.of(model.order) if model.arpa is None else model.counts.limit(0)  # tables from files may list n-grams of words they don't list
    t = saved(t.join(counted.select("ngram", F.lit(True).alias("seen")), "ngram", "left"), "asked")
    words = t.filter("seen is null").select("asked", F.posexplode(F.split("asked", UNIT)).alias("pos", "word"))
    words = words.join(model.vocabulary().withColumn("known", F.lit(True)), "word", "left")
    word = F.when(F.col("known"), F.col("word")).otherwise(UNK)
    ngram = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("word")))), lambda x: x["word"]), " ")
    return t.filter("seen").select("asked", "ngram").unionByName(words.groupBy("asked").agg(ngram.alias("ngram")))


def position_scores(sentences: DataFrame, model: Model, keys: Sequence[str], tokens: str, method: str, start: str = BOS) -> DataFrame:
    """(keys, p): the probability of each position of sentences that aren't empty. Each different n-gram is looked up once. The
    sentences are read twice, so they should be a table."""
    asked = positions(sentences, model.order, keys, tokens, start)
    known = saved(readable(asked, model), "readable")
    if method == "arpa":
        p = backoff(known.select("ngram").distinct(), model.arpa.select("n", "ngram", "logp"), model.arpa.select("n", "ngram", "bow"), model.order)
    else:
        p = (katz if method == "katz" else jelinek)(known, model, model.order)
    return asked.join(known.join(p, "ngram").select("asked", "p"), "asked").select(*keys, "p")


def coverage(tokens: DataFrame, model: Model, column: str = "tokens") -> DataFrame:
    """(total, oov, rate) of all words."""
    words = tokens.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    marked = words.join(model.vocabulary().withColumn("known", F.lit(1)), "word", "left")
    total, oov = F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("c"))), F.lit(0))
    return marked.agg(total.alias("total"), oov.alias("oov"), F.when(total > 0, oov / total).otherwise(0.0).alias("rate"))


def katz(queries: DataFrame, model: Model, n: int, column: str = "ngram") -> DataFrame:
    """(ngram, p) of the different n-grams of a table. A seen n-gram has its share of its context; an unseen one takes
    what the context's continuations leave of it, times the context's own probability; after a context that was never
    seen it has a uniform one. A context with a count is itself seen, so no order below it is asked."""
    total = model.total()
    asked = queries.select(F.col(column).alias("ngram")).distinct()
    t = asked.join(model.shares_of(n).select("ngram", "p"), "ngram", "left")
    if n == 1:
        return t.select("ngram", F.coalesce("p", F.lit(1) / F.lit(total)).alias("p"))
    after = model.shares_of(n - 1).select(F.col("ngram").alias("ctx"), "rest")
    t = t.withColumn("ctx", context(F.col("ngram"))).join(after, "ctx", "left")
    return t.select("ngram", F.coalesce("p", "rest", F.lit(1.0 / (total + 1))).alias("p"))


def jelinek(queries: DataFrame, model: Model, n: int, weights: Sequence[float] | None = None, column: str = "ngram") -> DataFrame:
    """(ngram, p): a weighted sum of the shares that the last 1, 2 to n words have of their contexts."""
    weights = weights or [1.0 / model.order] * model.order
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must add up to 1")
    t = parts(queries.select(F.col(column).alias("ngram")).distinct(), model, n)
    p = sum((F.lit(w) * F.col(f"p{k}") for k, w in enumerate(weights[:n], 1)), F.lit(0.0))
    return t.select("ngram", F.greatest(p, F.lit(FLOOR)).alias("p"))


def parts(asked: DataFrame, model: Model, n: int) -> DataFrame:
    """(ngram, p1 to pn): the share of the last k words among the counts of their context."""
    total = max(1, model.total())
    tail = lambda k: F.array_join(F.slice(F.split("ngram", " "), -k, k), " ")
    t = asked
    for k in range(1, n + 1):
        own = model.of(k).select(F.col("ngram").alias("t"), F.col("c").alias("num"))
        t = t.withColumn("t", tail(k)).join(own, "t", "left")
        if k == 1:
            t = t.withColumn("p1", F.coalesce("num", F.lit(0)) / F.lit(total)).drop("t", "num")
            continue
        of_ctx = model.of(k - 1).select(F.col("ngram").alias("ctx"), F.col("c").alias("den"))
        t = t.withColumn("ctx", context(F.col("t"))).join(of_ctx, "ctx", "left")
        t = t.withColumn(f"p{k}", F.coalesce("num", F.lit(0)) / F.coalesce("den", F.lit(1))).drop("t", "num", "ctx", "den")
    return t


def mixture(queries: DataFrame, a: Model, b: Model, weight: float, n: int, column: str = "ngram") -> DataFrame:
    """(ngram, logp): log10 of a weighted sum of two models' probabilities."""
    pa, pb = (jelinek(queries, m, n, column=column).withColumnRenamed("p", x) for m, x in ((a, "pa"), (b, "pb")))
    return pa.join(pb, "ngram").select("ngram", F.log10(F.greatest(weight * F.col("pa") + (1 - weight) * F.col("pb"), F.lit(FLOOR))).alias("logp"))


def fit_weights(sentences: DataFrame, model: Model, iterations: int = 5, tokens: str = "tokens") -> list[float]:
    """Weights of :func:`jelinek` by expectation-maximisation from equal ones. Positions are counted by n-gram once;
    each step is one sum over those counts."""
    order = model.order
    asked = sentences.select(F.explode(grams(padded(F.col(tokens), order), order)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("m"))
    names = [f"p{k}" for k in range(1, order + 1)]
    t = parts(asked.select("ngram"), model, order).join(asked, "ngram").groupBy(*[F.round(p, 12).alias(p) for p in names]).agg(F.sum("m").alias("m")).persist()
    weights = [1.0 / order] * order
    for _ in range(iterations):
        total = sum((F.lit(w) * F.col(p) for w, p in zip(weights, names, strict=True)), F.lit(0.0))
        row = t.filter(total >= FLOOR).agg(*[F.sum(F.col("m") * F.lit(w) * F.col(p) / total).alias(p) for w, p in zip(weights, names, strict=True)]).first()
        got = [row[p] or 0.0 for p in names]
        if sum(got) < FLOOR:
            break
        weights = [g / sum(got) for g in got]
    t.unpersist()
    return weights


def perplexity(sentences: DataFrame, model: Model, key: str, tokens: str = "tokens", method: str = "katz") -> DataFrame:
    """(key, perplexity): exp of the mean negative log probability of each sentence's positions; 1 for an empty one."""
    kept = saved(sentences.select(key, tokens), "sentences")
    p = position_scores(kept, model, [key], tokens, method)
    got = p.groupBy(key).agg(F.exp(F.avg(-F.log(F.greatest("p", F.lit(FLOOR))))).alias("perplexity"))
    return kept.select(key).join(got, key, "left").na.fill(1.0, ["perplexity"])


def arpa_tables(model: Model) -> DataFrame:
    """(n, ngram, logp, bow): log10 probabilities, and of contexts the backoff weight: log10 of the mass that seen
    continuations leave over what the lower order leaves without them, 1 at most; 0 where nothing is left."""
    out = model.shares().filter(F.col("n") <= model.order).select("n", "ngram", F.log10(F.greatest("p", F.lit(FLOOR))).alias("logp"))
    bows: DataFrame | None = None
    for n in range(1, model.order):
        upper = out.filter(F.col("n") == n + 1).select(context(F.col("ngram")).alias("ctx"), suffix(F.col("ngram")).alias("ngram"), F.pow(F.lit(10.0), "logp").alias("p"))
        lower = backoff(upper.select("ngram").distinct(), out, bows, n)
        sums = upper.join(lower.withColumnRenamed("p", "q"), "ngram").groupBy("ctx").agg((1 - F.sum("p")).alias("num"), (1 - F.sum("q")).alias("den"))
        bow = F.when((F.abs("den") < FLOOR) | (F.col("num") <= NOTHING), 0.0).otherwise(F.log10(F.least(F.col("num") / F.col("den"), F.lit(1.0))))
        got = model.of(n).select(F.lit(n).alias("n"), F.col("ngram")).join(sums.select(F.col("ctx").alias("ngram"), bow.alias("bow")), "ngram", "left").na.fill(0.0, ["bow"])
        bows = got if bows is None else bows.unionByName(got)
    return out.join(bows, ["n", "ngram"], "left") if bows is not None else out.withColumn("bow", F.lit(None).cast("double"))


def backoff(asked: DataFrame, logps: DataFrame, bows: DataFrame | None, n: int) -> DataFrame:
    """(ngram, p) by table: its own probability, or the context's backoff weight times the suffix's probability; a
    single word that isn't listed has that of the unknown word, or else a uniform one."""
    own = logps.filter(F.col("n") == n).select("ngram", F.pow(F.lit(10.0), "logp").alias("own"))
    t = asked.join(own, "ngram", "left")
    if n == 1:
        words = logps.filter(F.col("n") == 1).agg(F.max(F.when(F.col("ngram") == UNK, F.col("logp"))).alias("u"), F.count("*").alias("v")).first()
        rest = 10 ** words["u"] if words["u"] is not None else 1.0 / max(1, words["v"])
        return t.select("ngram", F.coalesce("own", F.lit(rest)).alias("p"))
    t = t.withColumns({"ctx": context(F.col("ngram")), "tail": suffix(F.col("ngram"))})
    lower = backoff(t.filter("own is null").select(F.col("tail").alias("ngram")).distinct(), logps, bows, n - 1)
    t = t.join(lower.select(F.col("ngram").alias("tail"), "p"), "tail", "left")
    bow = F.lit(0.0)
    if bows is not None:
        t = t.join(bows.filter(F.col("n") == n - 1).select(F.col("ngram").alias("ctx"), "bow"), "ctx", "left")
        bow = F.coalesce("bow", F.lit(0.0))
    return t.select("ngram", F.coalesce("own", F.pow(F.lit(10.0), bow) * F.col("p")).alias("p"))


def lm_scores(hyps: DataFrame, model: Model, keys: Sequence[str], tokens: str = "tokens", method: str = "katz") -> DataFrame:
    """(keys, lm_score): sum of log10 probabilities of each hypothesis. The start is padded with sentence ends here. Hypotheses
    are written once, with their other columns, not made again for the join."""
    kept = saved(hyps, "sentences")
    p = position_scores(kept, model, keys, tokens, method, EOS)
    got = p.groupBy(*keys).agg(F.sum(F.log10(F.greatest("p", F.lit(FLOOR)))).alias("lm_score"))
    return kept.join(got, list(keys), "left").na.fill(0.0, ["lm_score"])
