"""The two stages as specifications: which features, which model, how it is validated.

A specification names feature blocks; ``fit`` learns vocabularies, levels, medians and scales on
the training rows alone, so folds never leak; ``evaluate`` gives out-of-fold scores.
"""

from __future__ import annotations

from collections.abc import Callable
import json
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sectiva.functions.conditions import CONTRADICTION, applicability_frame
from sectiva.functions.records import clean_record, diagnosis_text, icd_category, icd_code
from sectiva.functions.text import lemma_map, record_words, title_words
from sectiva.functions.titles import guideline_name, invariant_tokens, parse_title, skeleton_features, struct_features, title_context
from sectiva.operators import models, vectorize
from sectiva.operators.boosting import boosted_scores, ordered_boosting
from sectiva.operators.design import Terms, design, fold_masks
from sectiva.operators.lemmas import own_lemmas
from sectiva.operators.metrics import best_threshold, first_best, m1, m2, sweep
from sectiva.operators.relational import pair_key
from sectiva.operators.solver import LOG, Fit, Problem, held_out, solve
from sectiva.operators.svd import truncated_svd
from sectiva.operators.validation import fold_scores, paired_deltas, stratified_folds
from sectiva.sources.stages import written

#: Relative step at which a fit has settled.
TOLERANCE = 1e-5
NUMERIC = ("age", "has_structured_header", "negation_count", "protocol_len")


@dataclass(frozen=True)
class TextBlock:
    """TF-IDF of an array column of terms."""

    name: str
    terms: str
    min_df: int = 2
    max_features: int | None = None
    sublinear: bool = False


@dataclass(frozen=True)
class Spec:
    """Feature blocks, the strength and the loss of the model; ``off`` drops blocks by name, ``weights`` scales them.

    The squared-hinge machine has its intercept in the penalty, as the usual toolkit has.
    """

    texts: tuple[TextBlock, ...] = ()
    numbers: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    c: float = 1.0
    loss: str = LOG
    off: frozenset[str] = frozenset()
    weights: dict[str, float] = field(default_factory=dict)

    def without(self, *names: str) -> Spec:
        return replace(self, off=self.off | set(names))


def stage2_spec(narrative: str = "narrative_lemma", extra_text=(), extra_categories=(), extra_numbers=(), c: float = 1.0) -> Spec:
    """The second-stage model: title and narrative words, numbers, sex, contradictions, and any extras."""
    texts = (TextBlock("title", "title_lemma"), TextBlock("narrative", narrative, max_features=20_000), *(TextBlock(x, x) for x in extra_text))
    return Spec(texts, (*NUMERIC, *CONTRADICTION, *extra_numbers), ("gender", *extra_categories), c)


def stage1_spec(c: float = 10.0) -> Spec:
    """The first-stage model: words of the subsection and its context, character n-grams, layout."""
    texts = (TextBlock("word", "sub_terms", sublinear=True), TextBlock("context", "ctx_terms", sublinear=True), TextBlock("char", "char_terms", min_df=3, sublinear=True))
    return Spec(texts, STRUCT, (), c)


STRUCT = tuple(f"s_{k}" for k in ("depth", "n_lines", "len_title", "len_subsection", "n_words_subsection", "n_words_guideline", "has_latin", "has_digit", "n_parens", "n_commas", "n_quotes", "n_cond_groups_sub", "n_cond_groups_ctx"))

#: Candidate inputs of the second stage by name.
CANDIDATES: dict[str, Spec] = {
    "B0": stage2_spec(extra_numbers=("noise",)), "B1": stage2_spec(extra_categories=("icd",)), "B2": stage2_spec(extra_categories=("icd_cat",)), "B3": stage2_spec(extra_categories=("title_x_icd",)),
    "B4": stage2_spec(extra_categories=("icd", "title_x_icd")), "B5": stage2_spec(extra_text=("diagnosis_lemma",)), "B6": stage2_spec(narrative="full_lemma"), "B7": stage2_spec(extra_text=("full_lemma",)),
    "C0": stage2_spec(extra_categories=("icd",), extra_text=("diagnosis_lemma",)), "D1": stage2_spec(extra_numbers=("p_llm",)), "D2": stage2_spec(extra_numbers=("logit_llm",)),
    "C1": stage2_spec(extra_categories=("icd",), extra_text=("diagnosis_lemma", "title_copies")), "C5_0.3": stage2_spec(extra_categories=("icd",), extra_text=("diagnosis_lemma",), c=0.3),
    "C5_3": stage2_spec(extra_categories=("icd",), extra_text=("diagnosis_lemma",), c=3.0),
}
#: Categories and components of the text for the candidates of trees (C2; C3 has the record's digest as a category, too).
TREE_CATEGORIES, TREE_COMPONENTS = ("title_text", "guideline", "icd", "icd_cat", "gender", "title_x_icd"), 30


def title_copies(df: DataFrame, title: str = "title_text", terms: str = "full_lemma") -> DataFrame:
    """``df`` with ``title_copies``: each distinct term marked with the row's title, a block of features of that title's own (C1)."""
    return df.withColumn("title_copies", F.transform(F.array_distinct(terms), lambda t: F.concat(F.md5(title), F.lit("§"), t)))


def tree_scores(train: DataFrame, test: DataFrame, key: str = "id", label: str = "label", terms: str = "full_lemma", numbers: tuple[str, ...] = (*NUMERIC, *CONTRADICTION, "has_icd"), categories: tuple[str, ...] = TREE_CATEGORIES, components: int = TREE_COMPONENTS, rounds: int = 600, depth: int = 4, rate: float = 0.05, seed: int = 0) -> DataFrame:
    """(key, proba) of ``test`` by ordered boosting fitted on ``train``: components of its words, numbers, and categories by ordered statistics (C2, C3).

    Vocabulary, components and statistics are those of ``train`` alone.
    """
    words = vectorize.TfIdf.fit(train, key, terms, 2, 20_000)
    words.vocabulary = written(words.vocabulary, "vocabulary")
    parts = truncated_svd(words.weights(train, key, terms), key, "term", components, seed=seed)
    n = len(parts.values)

    def inputs(rows: DataFrame) -> DataFrame:
        weights = words.weights(rows, key, terms).join(parts.terms.withColumnRenamed("term", "term_"), F.col("term") == F.col("term_"))
        on = weights.groupBy(F.col(key).alias("key_")).agg(*(F.sum(F.col("weight") * F.col("v")[j]).alias(f"svd{j}") for j in range(n)))
        return rows.join(on, F.col(key).eqNullSafe(F.col("key_")), "left").withColumns({f"svd{j}": F.coalesce(f"svd{j}", F.lit(0.0)) for j in range(n)})

    model = ordered_boosting(inputs(train), key, label, [*(f"svd{j}" for j in range(n)), *numbers], list(categories), rounds, depth, rate, seed=seed)
    return boosted_scores(model, inputs(test), key).select(F.col("key").alias(key), "proba")


def tree_folds(rows: DataFrame, fold: str, k: int, key: str = "id", label: str = "label", **more) -> DataFrame:
    """(key, label, fold, proba): out-of-fold scores of the candidates of trees on given folds."""
    each = [tree_scores(rows.filter(F.col(fold) != i), rows.filter(F.col(fold) == i), key, label, **more).withColumn("fold", F.lit(i)) for i in range(k)]
    scored = reduce(lambda a, b: a.unionByName(b), each)
    return scored.join(rows.select(key, label), key).select(key, label, "fold", "proba")


def once_per_text(df: DataFrame, texts: str, columns: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with columns that depend on one text alone, computed once for each distinct text and joined back by digest.

    ``columns`` takes a frame with the column ``texts`` and adds to it.
    """
    found = columns(df.select(texts).distinct())
    found = found.select(F.md5(texts).alias("_digest"), *(c for c in found.columns if c != texts))
    return df.join(found, F.md5(texts).eqNullSafe(F.col("_digest"))).drop("_digest")


def stage1_frame(df: DataFrame, title: str = "title_text", lemmas: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """``df`` with the inputs of the first stage; titles repeat, so each distinct one is parsed once.

    ``lemmas`` is a small dictionary, or a table (token, lemma) of any size, from which the lemmas of unknown words are guessed.
    """
    t = F.col(title)
    if isinstance(lemmas, DataFrame):
        return stage1_frame(own_lemmas(df, title, title_words(t), lemmas, "_lemmas"), title, F.col("_lemmas")).drop("_lemmas")
    inputs = stage1_inputs(t, lemmas)
    if isinstance(lemmas, Column):
        return df.withColumns(inputs)
    return once_per_text(df, title, lambda d: d.withColumns(inputs))


def stage1_inputs(t: Column, lemmas: dict[str, str] | Column | None = None) -> dict[str, Column]:
    """The inputs of the first stage from a title."""
    p = parse_title(t)
    words = lambda c: lemma_map(title_words(c), lemmas)
    return {
        "sub_terms": vectorize.word_ngrams(words(p["body"]), 1, 2), "ctx_terms": vectorize.word_ngrams(words(title_context(p)), 1, 2), "char_terms": vectorize.char_wb_ngrams(p["body"]),
        **{f"s_{k}": c for k, c in struct_features(t, lemmas).items()},
    }


def masked_frame(df: DataFrame, title: str = "title_text") -> DataFrame:
    """``df`` with features that masking leaves alone: shape n-grams and the skeleton."""
    shapes = F.filter(F.split(invariant_tokens(F.col(title)), r"\s+"), lambda x: x != "")
    return df.withColumns({"shape_terms": vectorize.word_ngrams(shapes, 1, 3, min_chars=1), **{f"k_{k}": c for k, c in skeleton_features(F.col(title)).items()}})


def stage2_inputs(df: DataFrame, lemmas: dict[str, str] | Column | None = None, record: str = "protocol_text", title: str = "title_text", record_lemmas: dict[str, str] | Column | None = None) -> DataFrame:
    """``df`` with the inputs of ``stage2_spec()`` alone, without those of its candidates."""
    return applicability_frame(df, title, record, lemmas, record_lemmas if isinstance(record_lemmas, Column) else None)


def stage2_frame(df: DataFrame, lemmas: dict[str, str] | DataFrame | None = None, record: str = "protocol_text", title: str = "title_text") -> DataFrame:
    """``df`` with the inputs of the second stage and of its candidates.

    Records repeat across titles, so what is costly about a record is computed once per record.  ``lemmas`` is a small
    dictionary, or a table (token, lemma) of any size, from which the lemmas of unknown words are guessed.
    """
    r, of_title, of_record = F.col(record), lemmas, lemmas
    if isinstance(lemmas, DataFrame):
        df = own_lemmas(own_lemmas(df, title, record_words(F.col(title)), lemmas, "_title_lemmas"), record, record_words(r), lemmas, "_record_lemmas")
        of_title, of_record = F.col("_title_lemmas"), F.col("_record_lemmas")
    cut = lambda c: lemma_map(record_words(c), of_record)
    costly = {"icd": icd_code(r), "diagnosis_lemma": cut(diagnosis_text(r)), "full_lemma": cut(clean_record(r))}
    d = stage2_inputs(df, of_title, record, title, of_record)
    d = d.withColumns(costly).drop("_title_lemmas", "_record_lemmas") if isinstance(lemmas, DataFrame) else once_per_text(d, record, lambda x: x.withColumns(costly))
    d = d.withColumn("icd_cat", icd_category(F.col("icd")))
    return d.withColumns({"guideline": guideline_name(F.col(title)), "title_x_icd": pair_key(F.col(title), F.col("icd")), "title_x_icd_cat": pair_key(F.col(title), F.col("icd_cat")), "has_icd": (F.col("icd") != "NA").cast("int")})


@dataclass
class Fitted:
    """What was learned from training rows."""

    spec: Spec
    key: str
    tfidf: dict[str, vectorize.TfIdf]
    scaler: vectorize.Scaler | None
    levels: dict[str, DataFrame]
    index: DataFrame
    size: int
    model: object = None

    def long(self, rows: DataFrame) -> DataFrame:
        """(key, term, weight) of all blocks."""
        on = lambda n: n not in self.spec.off
        w = lambda n: self.spec.weights.get(n, 1.0)
        parts = [vectorize.block(self.tfidf[b.name].weights(rows, self.key, b.terms), b.name, w(b.name)) for b in self.spec.texts if on(b.name)]
        if self.scaler and on("numbers"):
            parts.append(vectorize.block(vectorize.numeric_long(self.scaler.transform(rows), self.key, list(self.spec.numbers)), "numbers", w("numbers")))
        parts += [vectorize.block(vectorize.one_hot(rows, self.key, c, self.levels[c]), c, w(c)) for c in self.spec.categories if on(c)]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def vectors(self, rows: DataFrame, long: DataFrame | None = None) -> DataFrame:
        """``rows`` with sparse ``features``.

        A vector's parts are written as the structure that the vector type is stored as and read
        back as vectors, so no Python runs for a row.
        """
        index = F.broadcast(self.index) if self.size < 200_000 else self.index
        packed = (self.long(rows) if long is None else long).join(index, "term").groupBy(F.col(self.key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("i"), F.col("weight").alias("v")))).alias("_x"))
        x = F.coalesce("_x", F.array().cast("array<struct<i:int,v:double>>"))
        parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(max(self.size, 1)).alias("size"), F.transform(x, lambda e: e["i"]).alias("indices"), F.transform(x, lambda e: e["v"]).alias("values"))
        keys = rows.select(F.col(self.key).alias("_key")).distinct()
        built = keys.join(packed, F.col("_key").eqNullSafe(F.col("_k")), "left").select("_key", parts.alias("features"))
        vectors = written(built, "vectors", StructType([built.schema["_key"], StructField("features", VectorUDT())]))
        return rows.join(vectors, F.col(self.key).eqNullSafe(F.col("_key"))).drop("_key")

    def score(self, rows: DataFrame, out: str = "proba") -> DataFrame:
        return models.score(self.model, self.vectors(rows), out).drop("features")

    def save(self, path: str) -> None:
        """Write the specification, tables and model under ``path``; what is there is replaced."""
        spark = self.index.sparkSession
        told = {"spec": asdict(self.spec) | {"off": sorted(self.spec.off)}, "key": self.key, "size": self.size, "scaler": self.scaler.stats if self.scaler else None, "tables": [*self.tfidf, *self.levels]}
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/specification")
        tables = {f"terms-{n}": t.vocabulary for n, t in self.tfidf.items()} | {f"levels-{n}": t for n, t in self.levels.items()} | {"index": self.index}
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(f"{path}/{name}")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark, path: str) -> Fitted:
        """What ``save`` wrote; it scores as it did."""
        told = json.loads(spark.read.text(f"{path}/specification").first().value)
        own = told["spec"]
        spec = Spec(tuple(TextBlock(**b) for b in own["texts"]), tuple(own["numbers"]), tuple(own["categories"]), own["c"], own["loss"], frozenset(own["off"]), own["weights"])
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        tfidf = {b.name: vectorize.TfIdf(read(f"terms-{b.name}"), b.sublinear) for b in spec.texts}
        scaler = vectorize.Scaler({k: tuple(v) for k, v in told["scaler"].items()}) if told["scaler"] else None
        return cls(spec, told["key"], tfidf, scaler, {c: read(f"levels-{c}") for c in spec.categories}, read("index"), told["size"], LogisticRegressionModel.load(f"{path}/model"))


def fit(train: DataFrame, spec: Spec, key: str = "id", label: str = "label") -> Fitted:
    """Vocabularies, scales and levels, then the balanced logistic model, from ``train`` alone."""
    tfidf = {b.name: vectorize.TfIdf.fit(train, key, b.terms, b.min_df, b.max_features, b.sublinear) for b in spec.texts}
    scaler = vectorize.Scaler.fit(train, list(spec.numbers)) if spec.numbers else None
    levels = {c: train.select(c).distinct() for c in spec.categories}
    got = Fitted(spec, key, tfidf, scaler, levels, None, 0)
    for t in tfidf.values():
        t.vocabulary = written(t.vocabulary, "vocabulary")
    long = written(got.long(train), "weights")
    got.index = written(vectorize.feature_index(long), "features")
    got.size = got.index.count()
    got.model = models.logistic(got.vectors(train.select(key, label), long).select("features", label), label, c=spec.c)
    return got


def fitter(spec: Spec, key: str = "id", label: str = "label") -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    return lambda train: fit(train, spec, key, label).score


def _shared(rows: DataFrame, specs: list[Spec], key: str, label: str, sets: int, weight: str | None = None) -> Problem:
    """One problem for specifications that may differ in blocks, weights and strength, over rows with training and test masks."""
    texts = {_block(b): Terms(_block(b), b.terms, b.min_df, b.max_features, b.sublinear) for s in specs for b in s.texts if b.name not in s.off}
    numbers = list(dict.fromkeys(x for s in specs if "numbers" not in s.off for x in s.numbers))
    categories = list(dict.fromkeys(c for s in specs for c in s.categories if c not in s.off))
    if len({frozenset(s.numbers) for s in specs if "numbers" not in s.off}) > 1:
        raise ValueError("specifications that are fitted together must share their numbers")
    return design(rows, key, label, sets, list(texts.values()), categories, numbers, weight=weight)


def _block(b: TextBlock) -> str:
    return f"{b.name}|{b.terms}|{b.min_df}|{b.max_features}|{b.sublinear}"


def _fit(problem: Problem, spec: Spec, group: int) -> Fit:
    """The model of a specification on one training set: blocks that it lacks or switches off weigh 0."""
    own = {_block(b): spec.weights.get(b.name, 1.0) for b in spec.texts if b.name not in spec.off}
    own |= {c: spec.weights.get(c, 1.0) for c in spec.categories if c not in spec.off}
    if spec.numbers and "numbers" not in spec.off:
        own["numbers"] = spec.weights.get("numbers", 1.0)
    return Fit(group, spec.c, tuple((b, own.get(b, 0.0)) for b in problem.blocks), spec.loss, spec.loss == LOG)


def _together(rows: DataFrame, specs: list[Spec], key: str, label: str, sets: int, tol: float = TOLERANCE, weight: str | None = None) -> DataFrame:
    """(key, y, fit, proba): test rows scored by every specification on every training set, all fitted at once; ``fit`` is specification * sets + set.

    Specifications whose numbers differ are designed apart.
    """
    by_numbers: dict[tuple, list[int]] = {}
    for i, s in enumerate(specs):
        by_numbers.setdefault(() if "numbers" in s.off else tuple(s.numbers), []).append(i)
    scored = []
    for own in by_numbers.values():
        problem = _shared(rows, [specs[i] for i in own], key, label, sets, weight)
        fits = [_fit(problem, specs[i], g) for i in own for g in range(sets)]
        numbered = F.element_at(F.array(*(F.lit(i * sets) for i in own)), F.floor(F.col("fit") / sets).cast("int") + 1) + F.col("fit") % sets
        found = held_out(problem, fits, solve(problem, fits, tol))
        # A margin without a probability: what is thresholded is the margin itself.
        found = found.withColumn("proba", F.when(F.element_at(F.array(*(F.lit(f.loss == LOG) for f in fits)), F.col("fit") + 1), F.col("proba")).otherwise(F.col("margin")))
        scored.append(written(found.select("key", "y", numbered.alias("fit"), "proba"), "scores"))
        problem.packed.unpersist()
    return reduce(lambda a, b: a.unionByName(b), scored)


def evaluate(rows: DataFrame, spec: Spec, key: str = "id", label: str = "label", k: int = 5, seed: int = 0) -> DataFrame:
    """(key, label, fold, proba): out-of-fold scores on stratified folds, all folds fitted at once; ``key`` must be unique."""
    inputs = dict.fromkeys([key, label, *(b.terms for b in spec.texts), *spec.numbers, *spec.categories])
    folded = written(stratified_folds(written(rows.select(*inputs), "inputs"), key, label, k, seed), "folds")
    got = evaluate_folds(folded, [spec], "fold", k, key, label)
    return got.select(key, label, F.col("fold").cast("int").alias("fold"), "proba")


def evaluate_texts(rows: DataFrame, text: str, columns: Callable[[DataFrame], DataFrame], spec: Spec, key: str = "id", label: str = "label", k: int = 5, seed: int = 0) -> DataFrame:
    """``evaluate`` for inputs that depend on one text alone: ``columns`` takes a frame with the column ``text`` and adds them to it.

    Inputs are made for distinct texts; rows travel with the digest of theirs, and rows of one text, label and fold are fitted and scored as one with a weight.
    """
    said = written(rows.select(key, label, text), "inputs")
    inputs = dict.fromkeys([*(b.terms for b in spec.texts), *spec.numbers, *spec.categories])
    found = columns(said.select(text).distinct()).select(F.md5(text).alias("_text"), *inputs)
    parts = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("_digest", label, "fold")))
    folded = written(stratified_folds(said.select(key, label, F.md5(text).alias("_digest")), key, label, k, seed).withColumn("_same", F.md5(parts)), "folds")
    alike = folded.groupBy("_same", "_digest", label, "fold").agg(F.count("*").alias("_times"))
    wide = written(alike.join(found, F.col("_digest").eqNullSafe(F.col("_text"))).drop("_digest", "_text"), "texts")
    got = evaluate_folds(wide, [spec], "fold", k, "_same", label, weight="_times")
    return folded.join(got.select("_same", "proba"), "_same").select(key, label, F.col("fold").cast("int").alias("fold"), "proba")


def evaluate_folds(rows: DataFrame, specs: list[Spec], fold: str, k: int, key: str = "id", label: str = "label", tol: float = TOLERANCE, weight: str | None = None) -> DataFrame:
    """(spec, key, label, fold, proba): out-of-fold scores of several specifications on given folds 0 to k - 1, all fitted at once; a row stands for ``weight`` equal ones."""
    got = _together(rows.withColumns(fold_masks(fold, k)), specs, key, label, k, tol, weight)
    return got.select(F.floor(F.col("fit") / k).cast("int").alias("spec"), F.col("key").alias(key), F.col("y").cast(dict(rows.dtypes)[label]).alias(label), (F.col("fit") % k).alias("fold"), "proba")


def nested_folds(rows: DataFrame, key: str, label: str, k: int, inner: int, seed: int) -> DataFrame:
    """``rows`` with ``fold`` and the masks of nested validation: sets 0 to k - 1 are the outer ones, then ``inner`` for each outer fold's training rows."""
    folded = written(stratified_folds(rows, key, label, k, seed), "folds")
    light = folded.select(key, label, "fold")
    parts = (stratified_folds(light.filter(F.col("fold") != i).drop("fold"), key, label, inner, seed + 1).select(F.col(key).alias("key_"), F.lit(i).alias("outer"), F.col("fold").alias("inner")) for i in range(k))
    whole, own = F.expr(f"shiftleft({(1 << inner) - 1}L, {k} + outer * {inner})"), F.expr(f"shiftleft(1L, {k} + outer * {inner} + inner)")
    masks = reduce(lambda a, b: a.unionByName(b), parts).groupBy("key_").agg(F.bit_or(own).alias("tests"), F.bit_or(whole).alias("sets"))
    outer = fold_masks("fold", k)
    joined = folded.join(masks, F.col(key) == F.col("key_"), "left").drop("key_")
    tests, sets = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("tests", "sets"))
    return joined.withColumns({"train": outer["train"].bitwiseOR(sets.bitwiseXOR(tests)), "test": outer["test"].bitwiseOR(tests)}).drop("tests", "sets")


def given_nested_folds(rows: DataFrame, outer: str, k: int, inside: str, inner: int) -> DataFrame:
    """``rows`` with the masks of nested validation on given folds: ``outer`` from 0 to k - 1, and ``inside`` from 0 to inner - 1, used within each outer fold's training rows."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda o: o != F.col(outer))
    tests = F.aggregate(others, F.lit(0).cast("bigint"), lambda acc, o: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(k) + o * inner + F.col(inside)).cast("int"))))
    sets = F.aggregate(others, F.lit(0).cast("bigint"), lambda acc, o: acc.bitwiseOR(F.call_function("shiftleft", F.lit((1 << inner) - 1).cast("bigint"), (F.lit(k) + o * inner).cast("int"))))
    own = fold_masks(outer, k)
    return rows.withColumns({"train": own["train"].bitwiseOR(sets.bitwiseXOR(tests)), "test": own["test"].bitwiseOR(tests)})


def nested_scores(rows: DataFrame, specs: list[Spec], key: str = "id", label: str = "label", k: int = 5, inner: int = 5, seed: int = 0, metric: str = "m1", folds: tuple[str, str] | None = None) -> DataFrame:
    """(spec, fold, threshold, m1, m2, tp, fp, fn, tn): thresholds tuned by inner folds, scored on outer ones, for every specification at once.

    Folds are stratified, by ``seed``, unless ``folds`` names columns with those to use.
    """
    sets = k + k * inner
    masked = given_nested_folds(rows, folds[0], k, folds[1], inner) if folds else nested_folds(rows, key, label, k, inner, seed)
    got = written(_together(masked, specs, key, label, sets).select(F.floor(F.col("fit") / sets).cast("int").alias("spec"), (F.col("fit") % sets).cast("int").alias("set"), "y", "proba"), "nested")
    outer = F.when(F.col("set") < k, F.col("set")).otherwise(F.floor((F.col("set") - k) / inner)).cast("int")
    inside = sweep(got.filter(F.col("set") >= k).withColumn("fold", outer), "y", "proba", by=["spec", "fold"])
    chosen = best_threshold(inside, metric, ["spec", "fold"]).select("spec", "fold", "threshold")
    tested = sweep(got.filter(F.col("set") < k).withColumn("fold", outer), "y", "proba", by=["spec", "fold"])
    return tested.join(chosen, ["spec", "fold", "threshold"]).select("spec", "fold", "threshold", "m1", "m2", "tp", "fp", "fn", "tn")


def nested(rows: DataFrame, spec: Spec, key: str = "id", label: str = "label", k: int = 5, inner: int = 5, seed: int = 0, metric: str = "m1") -> list[tuple[int, float, float]]:
    """(outer fold, threshold, score): thresholds tuned by inner folds, scored on outer ones."""
    return [(r.fold, r.threshold, r[metric]) for r in nested_scores(rows, [spec], key, label, k, inner, seed, metric).orderBy("fold").collect()]


def grid_scores(rows: DataFrame, specs: list[Spec], metric: str = "m1", key: str = "id", label: str = "label", k: int = 5, seed: int = 0) -> DataFrame:
    """(spec, threshold, metric): the best threshold of every specification's out-of-fold scores, on the same folds, all fitted at once."""
    folded = written(stratified_folds(rows, key, label, k, seed), "folds")
    got = _together(folded.withColumns(fold_masks("fold", k)), specs, key, label, k)
    return best_threshold(sweep(got.withColumn("spec", F.floor(F.col("fit") / k).cast("int")), "y", "proba", by=["spec"]), metric, ["spec"])


def grid_search(rows: DataFrame, specs: dict[str, Spec], metric: str = "m1", **kw) -> list[tuple[str, float, float]]:
    """(name, threshold, score) of every specification on the same folds, best first; ties keep the given order."""
    names = list(specs)
    found = sorted(grid_scores(rows, list(specs.values()), metric, **kw).collect(), key=lambda r: r.spec)
    return sorted(((names[r.spec], r.threshold, r[metric]) for r in found), key=lambda x: -x[2])


def stage1_grid(strengths=(1.0, 3.0, 10.0, 30.0), min_dfs=(1, 2, 3), grams=((3, 4), (3, 5), (2, 5), (3, 6))) -> dict[str, Spec]:
    """First-stage specifications over character n-grams, minimum frequency and strength; ``gram_frame`` adds their columns."""
    named = {}
    for lo, hi in grams:
        for m in min_dfs:
            for c in strengths:
                base = stage1_spec(c)
                texts = (*base.texts[:2], TextBlock("char", f"char_{lo}_{hi}", min_df=m, sublinear=True))
                named[f"{lo}-{hi}/{m}/{c:g}"] = replace(base, texts=texts)
    return named


def gram_frame(df: DataFrame, title: str = "title_text", grams=((3, 4), (3, 5), (2, 5), (3, 6)), lemmas: dict[str, str] | None = None) -> DataFrame:
    """``stage1_frame`` with a column of character n-grams for each range of lengths."""
    body = parse_title(F.col(title))["body"]
    return once_per_text(stage1_frame(df, title, lemmas), title, lambda d: d.withColumns({f"char_{lo}_{hi}": vectorize.char_wb_ngrams(body, lo, hi) for lo, hi in grams}))


def decoded_frame(df: DataFrame, decoded: DataFrame, key: str = "id", lemmas: dict[str, str] | None = None) -> DataFrame:
    """``df`` with first-stage words from decoded titles (``decode_titles``), condition words, and coverage.

    A row without a decoded title has no words and coverage 0.
    """
    words = lambda c: lemma_map(title_words(F.coalesce(c, F.lit(""))), lemmas or {})
    context = F.concat_ws(" ", "guideline", "age_category", F.array_join(F.coalesce("hierarchy", F.array().cast("array<string>")), " "))
    parts = decoded.select(F.col(key).alias("_k"), "body", "coverage", context.alias("_context"))
    joined = df.join(parts, F.col(key) == F.col("_k"), "left")
    terms = {"sub_terms": vectorize.word_ngrams(words(F.col("body")), 1, 2), "ctx_terms": vectorize.word_ngrams(words(F.col("_context")), 1, 2), "char_terms": vectorize.char_wb_ngrams(F.coalesce("body", F.lit("")))}
    groups = F.size(F.split(F.regexp_replace(F.coalesce("body", F.lit("")), "[^,;()]", ""), "")) - 1
    return joined.withColumns({**terms, "s_coverage": F.coalesce("coverage", F.lit(0.0)), "s_decoded_chars": F.length(F.coalesce("body", F.lit(""))), "s_clauses": groups}).drop("_k", "body", "coverage", "_context")


def select_strength(rows: DataFrame, spec: Spec, strengths=(1.0, 3.0, 10.0, 30.0), **kw) -> dict[float, float]:
    """Mean nested score by strength of the model; all strengths are fitted at once."""
    metric = kw.get("metric", "m1")
    found = nested_scores(rows, [replace(spec, c=c) for c in strengths], **kw).groupBy("spec").agg(F.avg(metric).alias("score")).collect()
    return {strengths[r.spec]: r.score for r in sorted(found, key=lambda r: r.spec)}


def pooled_selection(rows: DataFrame, spec: Spec, strengths=(1.0, 3.0, 10.0, 30.0), **kw) -> DataFrame:
    """(c, pooled, mean, sd, threshold): the nested score of all test rows together, mean and deviation over folds, and the median threshold, by strength."""
    metric = kw.get("metric", "m1")
    per = nested_scores(rows, [replace(spec, c=c) for c in strengths], **kw)
    pooled = per.groupBy("spec").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("sd"), F.median("threshold").alias("threshold"))
    strength = F.element_at(F.array(*(F.lit(float(c)) for c in strengths)), F.col("spec") + 1)
    return pooled.select(strength.alias("c"), (m1() if metric == "m1" else m2()).alias("pooled"), "mean", "sd", "threshold")


def compare(rows: DataFrame, candidate: Spec, baseline: Spec, seeds=(0, 1, 2, 3, 4), k: int = 5, threshold: float = 0.5, key: str = "id", label: str = "label") -> DataFrame:
    """(seed, fold, n, delta): scores of two specifications on the same repeated folds, all fitted at once."""
    seeds = list(seeds)
    parts = (stratified_folds(rows.select(key, label), key, label, k, s).select(F.col(key).alias("key_"), (F.lit(i * k) + F.col("fold")).alias("set")) for i, s in enumerate(seeds))
    masks = reduce(lambda a, b: a.unionByName(b), parts).groupBy("key_").agg(F.bit_or(F.expr("shiftleft(1L, set)")).alias("test"))
    sets = len(seeds) * k
    folded = written(rows.join(masks, F.col(key) == F.col("key_")).drop("key_").withColumn("train", F.lit((1 << sets) - 1).cast("bigint").bitwiseXOR(F.col("test"))), "folds")
    got = _together(folded, [candidate, baseline], key, label, sets).withColumn("pred", (F.col("proba") >= threshold).cast("int"))
    at = F.col("fit") % sets
    seed = F.element_at(F.array(*map(F.lit, seeds)), F.floor(at / k).cast("int") + 1)
    named = got.select(F.floor(F.col("fit") / sets).alias("spec"), seed.alias("seed"), (at % k).cast("int").alias("fold"), F.col("y").alias("label"), "pred")
    tables = [fold_scores(named.filter(F.col("spec") == i), "label", "pred", ["seed", "fold"]) for i in (0, 1)]
    return paired_deltas(*tables, ["seed", "fold"])


def threshold_gap(oof: DataFrame, label: str = "label", score: str = "proba", metric: str = "m2", shipped: float = 0.5, thresholds: list[float] | None = None) -> DataFrame:
    """(fold, threshold, best, at_shipped, gap): the lowest best threshold of each fold itself, an upper bound for tuning, against a shipped one.

    ``shipped`` must be on the grid.
    """
    swept = sweep(oof, label, score, thresholds, ["fold"])
    own = first_best(swept, metric, ["fold"]).select("fold", "threshold", F.col(metric).alias("best"))
    at = swept.filter(F.abs(F.col("threshold") - shipped) < 1e-9).select("fold", F.col(metric).alias("at_shipped"))
    return own.join(at, "fold").withColumn("gap", F.col("best") - F.col("at_shipped"))
