"""Reports over clusterings, and small one-dimensional operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def size_summary(labels: DataFrame) -> DataFrame:
    """One row: clusters, largest, median, smallest, noise."""
    noise = labels.agg(F.sum((F.col("label") < 0).cast("bigint")).alias("noise"))
    found = cluster_sizes(labels.filter("label >= 0")).agg(
        F.count("*").alias("clusters"), F.max("size").alias("largest"), F.percentile("size", 0.5).alias("median"), F.min("size").alias("smallest")
    )
    return found.join(F.broadcast(noise))  # one row each


def purity(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """label, size, dominant, purity: of each cluster its most frequent class (ties: the least) and its share."""
    counts = labels.filter("label >= 0").join(truth, "id").groupBy("label", "class").agg(F.count("*").alias("n"))
    found = counts.groupBy("label").agg(F.sum("n").alias("size"), F.max(F.struct("n", -F.col("class"))).alias("top"))
    return found.select("label", "size", (-F.col("top.col2")).alias("dominant"), (F.col("top.n") / F.col("size")).alias("purity"))


def mean_purity(found: DataFrame) -> DataFrame:
    """One row; NaN of no cluster."""
    return found.agg(F.coalesce(F.avg("purity"), F.lit(float("nan"))).alias("mean_purity"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """left, right, common, iou of every pair of clusters that share a row."""
    left, right = a.filter("label >= 0").select("id", F.col("label").alias("left")), b.filter("label >= 0").select("id", F.col("label").alias("right"))
    common = left.join(right, "id").groupBy("left", "right").agg(F.count("*").alias("common"))
    common = common.join(left.groupBy("left").agg(F.count("*").alias("n")), "left").join(right.groupBy("right").agg(F.count("*").alias("m")), "right")
    return common.select("left", "right", "common", (F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("iou"))


def matches(found: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of at least that overlap, each cluster once. From one half on, pairs of greatest overlap on both
    sides are those that greedy matching takes."""
    mine, theirs = Window.partitionBy("left").orderBy(F.desc("iou"), "right"), Window.partitionBy("right").orderBy(F.desc("iou"), "left")
    ranked = found.filter(F.col("iou") >= least).withColumn("a", F.row_number().over(mine)).withColumn("b", F.row_number().over(theirs))
    return ranked.filter("a = 1 and b = 1").drop("a", "b")


def peaks(series: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows of series that are peaks: higher than the runs of equal values around; of a run its middle row (the
    earlier of two). Ends are never peaks."""
    run = Window.partitionBy(*by).orderBy(order)
    marked = series.withColumn("_at", F.row_number().over(run)).withColumn("_last", F.lag(value).over(run))
    marked = marked.withColumn("_run", F.sum(F.when(F.col("_last").isNull() | (F.col("_last") != F.col(value)), 1).otherwise(0)).over(run))
    runs = marked.groupBy(*by, "_run").agg(F.min("_at").alias("_first"), F.max("_at").alias("_end"), F.first(value).alias("_value"))
    near = Window.partitionBy(*by).orderBy("_run")
    runs = runs.withColumn("_before", F.lag("_value").over(near)).withColumn("_after", F.lead("_value").over(near))
    high = runs.filter((F.col("_value") > F.col("_before")) & (F.col("_value") > F.col("_after")))
    middle = high.select(*by, F.floor((F.col("_first") + F.col("_end")) / 2).cast("int").alias("_at"))
    return marked.join(middle, [*by, "_at"]).select(series.columns)


def total_persistence(bars: DataFrame) -> DataFrame:
    """size, total: for each distinct birth the summed (death - birth) * fade of the bars alive at it."""
    sizes = bars.select(F.col("birth").alias("size")).distinct()
    alive = sizes.join(bars.filter("death > birth and not root"), (F.col("size") >= F.col("birth")) & (F.col("size") < F.col("death")), "left")
    return alive.groupBy("size").agg(F.coalesce(F.sum((F.col("death") - F.col("birth")) * F.col("fade")), F.lit(0.0)).alias("total"))


def active_similarity(bars: DataFrame, one: float, two: float) -> DataFrame:
    """One row, jaccard: of the clusters alive at two sizes."""
    def alive(size: float):
        return (F.col("birth") <= size) & (F.col("death") > size)

    counts = bars.agg(F.sum((alive(one) & alive(two)).cast("int")).alias("common"), F.sum((alive(one) | alive(two)).cast("int")).alias("any"))
    return counts.select(F.when(F.col("any") > 0, F.col("common") / F.col("any")).otherwise(0.0).alias("jaccard"))


def run_times(times: DataFrame, by: str, seconds: str) -> DataFrame:
    return times.groupBy(by).agg(F.percentile(seconds, 0.5).alias("median"), F.min(seconds).alias("least"), F.max(seconds).alias("greatest"))


#: Names of classes by number.
CLASS_NAMES = {
    "digits": ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"],
    "fashion": ["T-shirt/top", "Trouser", "Pullover", "Dress", "Coat", "Sandal", "Shirt", "Sneaker", "Bag", "Ankle boot"],
    "news5": ["business", "entertainment", "politics", "sport", "tech"],
    "news20": [
        "alt.atheism",
        "comp.graphics",
        "comp.os.ms-windows.misc",
        "comp.sys.ibm.pc.hardware",
        "comp.sys.mac.hardware",
        "comp.windows.x",
        "misc.forsale",
        "rec.autos",
        "rec.motorcycles",
        "rec.sport.baseball",
        "rec.sport.hockey",
        "sci.crypt",
        "sci.electronics",
        "sci.med",
        "sci.space",
        "soc.religion.christian",
        "talk.politics.guns",
        "talk.politics.mideast",
        "talk.politics.misc",
        "talk.religion.misc",
    ],
}


def class_name(label, names: str):
    """Column: the name of a class number, or "?"."""
    listed = F.array(*map(F.lit, CLASS_NAMES[names]))
    return F.coalesce(F.when(label >= 0, F.get(listed, label.cast("int"))), F.lit("?"))
