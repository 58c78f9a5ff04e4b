"""Text classification, model selection and clustering with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import fold
from tamiz.operators.ranking import ranked
from tamiz.session import materialise

FEATURES = 1 << 12


def candidates(seed: int = 42) -> dict:
    """The estimators that selection compares."""
    return {
        "NaiveBayes": NaiveBayes(smoothing=0.1),
        "SVM": OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.01), parallelism=8),
        "LogisticRegression": LogisticRegression(maxIter=20, regParam=0.001),
        "RandomForest": RandomForestClassifier(numTrees=100, seed=seed),
    }


def _stages(n_features: int) -> list:
    return [
        RegexTokenizer(inputCol="_plain", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features", p=2.0),
    ]


def _prepared(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_plain", fold(F.coalesce(text, F.lit(""))))


def train(df: DataFrame, text: str = "texto", label: str = "etiqueta", estimator=None, n_features: int = FEATURES) -> tuple[PipelineModel, list[str]]:
    """(model, labels in index order). At least two labels are needed; rows without text or label are left out."""
    # Cached: every pass of an iterative estimator reads the same prepared rows.
    rows = _prepared(df.where((F.trim(text) != "") & F.col(label).isNotNull()), text).persist()
    if rows.select(label).distinct().limit(2).count() < 2:
        raise ValueError("at least two labels are needed")
    indexer = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    model = Pipeline(stages=[indexer, *_stages(n_features), estimator or candidates()["SVM"]]).fit(rows)
    rows.unpersist()
    return model, list(model.stages[0].labels)


def predict(model: PipelineModel, labels: list[str], df: DataFrame, text: str = "texto") -> DataFrame:
    """Add ``prediccion``, the label of each text."""
    rows = _prepared(df, text)
    for stage in model.stages[1:]:
        rows = stage.transform(rows)
    names = F.array(*[F.lit(x) for x in labels])
    kept = [c for c in df.columns]
    return rows.select(*kept, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("prediccion"))


def folds(df: DataFrame, label: str, k: int, ident: str) -> DataFrame:
    """Add ``pliegue``: stratified folds, by rank of a hash within each label."""
    placed = ranked(df.withColumn("_h", F.xxhash64(ident, F.lit(42))), [label], [F.asc("_h"), F.asc(ident)], "_rank")
    return placed.withColumn("pliegue", (F.col("_rank") - 1) % k).drop("_rank", "_h")


def select_model(df: DataFrame, ident: str, text: str = "texto", label: str = "etiqueta", k: int = 5, models: dict | None = None, n_features: int = FEATURES) -> DataFrame:
    """(modelo, media, desviacion, pliegues): accuracy of each estimator over stratified folds, best mean first.

    The folds are no more than the smallest label has texts; fewer than two are
    an error. Every fold is a filter of one written table.
    """
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    k = min(k, smallest)
    if k < 2:
        raise ValueError("every label needs two texts or more")
    cut = materialise(folds(df, label, k, ident), "folds")
    rows = []
    for name, estimator in (models or candidates()).items():
        for fold_number in range(k):
            model, labels = train(cut.where(F.col("pliegue") != fold_number), text, label, estimator, n_features)
            right = predict(model, labels, cut.where(F.col("pliegue") == fold_number), text).agg(F.avg((F.col("prediccion") == F.col(label)).cast("double"))).first()[0]
            rows.append((name, float(right or 0.0)))
    scores = df.sparkSession.createDataFrame(rows, "modelo string, exactitud double")
    return scores.groupBy("modelo").agg(F.avg("exactitud").alias("media"), F.stddev_pop("exactitud").alias("desviacion"), F.count("*").alias("pliegues")).orderBy(F.desc("media"), "desviacion", "modelo")


def classification_report(predicted: DataFrame, label: str = "etiqueta", prediction: str = "prediccion") -> DataFrame:
    """(clase, precision, recall, f1, soporte) from one table of confusion counts."""
    counts = predicted.groupBy(label, prediction).agg(F.count("*").alias("n"))
    right = counts.where(F.col(label) == F.col(prediction)).select(F.col(label).alias("clase"), F.col("n").alias("tp"))
    support = counts.groupBy(F.col(label).alias("clase")).agg(F.sum("n").alias("soporte"))
    given = counts.groupBy(F.col(prediction).alias("clase")).agg(F.sum("n").alias("dados"))
    out = support.join(right, "clase", "left").join(given, "clase", "left").na.fill(0)
    precision, recall = F.coalesce(F.try_divide("tp", "dados"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "soporte"), F.lit(0.0))
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    return out.select("clase", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "soporte")


def clusters(df: DataFrame, ident: str, text: str, k: int, n_features: int = FEATURES, seed: int = 42) -> DataFrame:
    """(ident, grupo): k-means over TF-IDF vectors."""
    rows = _prepared(df.where(F.trim(text) != ""), text)
    features = Pipeline(stages=_stages(n_features)).fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, maxIter=20).fit(features)
    return model.transform(features).select(ident, F.col("prediction").alias("grupo"))
