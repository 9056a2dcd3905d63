"""Annotation files (COCO, LVIS, Pascal VOC, Cityscapes) as tables of images and of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tesserae.session import at_most, written

POLYGON = T.ArrayType(T.ArrayType(T.DoubleType()))
COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("coco_url", T.StringType()), T.StructField("neg_category_ids", T.ArrayType(T.LongType())), T.StructField("not_exhaustive_category_ids", T.ArrayType(T.LongType()))]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("isthing", T.IntegerType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("iscrowd", T.IntegerType()), T.StructField("ignore", T.IntegerType()), T.StructField("area", T.DoubleType()), T.StructField("segmentation", T.StringType()), T.StructField("keypoints", T.ArrayType(T.DoubleType()))]))),
    ]
)


def contiguous(categories: DataFrame, key: str = "id") -> DataFrame:
    """category id and class 0 .. n - 1, in the order of ids. Categories are few and are counted."""
    if not at_most(categories):
        raise ValueError("too many categories")
    ids = categories.agg(F.array_sort(F.collect_set(key)).alias("ids"))
    return ids.select(F.posexplode("ids").alias("class", key)).select(key, F.col("class").cast("long").alias("class"))


def remap(rows: DataFrame, categories: DataFrame, key: str = "category_id", strict: bool = True) -> DataFrame:
    """rows with class instead of category ids; an unknown id is an error if strict, else its rows go."""
    known = contiguous(categories).withColumnRenamed("id", key)
    known = F.broadcast(known) if at_most(known) else known
    if not strict:
        return rows.join(known, key)
    out = rows.join(known, key, "left")
    bad = F.raise_error(F.concat(F.lit("unknown category "), F.col(key).cast("string"))).cast("long")
    return out.withColumn("class", F.when(F.col("class").isNull(), bad).otherwise(F.col("class")))


def valid_polygons(segmentation: Column) -> Column:
    """Polygons of an even number, at least six, of coordinates."""
    return F.filter(segmentation, lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))


def shift_keypoints(keypoints: Column, by: float = 0.5) -> Column:
    """x and y, not the visibility, moved to pixel centres."""
    return F.transform(keypoints, lambda v, i: F.when(i % 3 == 2, v).otherwise(v + by))


def read_coco(spark: SparkSession, path: str, lvis: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, categories and annotations of files in COCO's form.

    Polygons that aren't valid are dropped, objects with none left too; keypoints move to pixel centres; an annotation id that occurs
    twice is an error. In LVIS categories count from 1 and a file name is the last two parts of its URL."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    if lvis:
        parts = F.split("coco_url", "/")
        images = images.withColumn("file_name", F.coalesce(F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))), "file_name"))
    categories = doc.select(F.explode("categories").alias("c")).select("c.*")
    rows = doc.select(F.explode("annotations").alias("a")).select("a.*").where(F.coalesce("ignore", F.lit(0)) == 0)
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("annotation ids occur more than once")
    is_polygon = F.col("segmentation").startswith("[")
    polygons = valid_polygons(F.from_json(F.when(is_polygon, F.col("segmentation")), POLYGON))
    out = rows.withColumn("polygons", polygons).withColumn("rle", F.when(~is_polygon, F.col("segmentation")))
    out = out.where(F.col("polygons").isNull() | (F.size("polygons") > 0)).drop("segmentation", "ignore")
    out = out.withColumn("keypoints", shift_keypoints(F.col("keypoints")))
    out = out.withColumn("class", F.col("category_id") - 1) if lvis else remap(out, categories)
    return images, categories, out


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """file, name, difficult and box of the objects in VOC files; corners move to 0-based pixels."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    get = lambda tag: F.xpath("value", F.lit(f"annotation/object/{tag}/text()"))
    rows = files.select("file", F.explode(F.arrays_zip(get("name").alias("name"), F.xpath("value", F.lit("annotation/object/bndbox/xmin/text()")).alias("xmin"), F.xpath("value", F.lit("annotation/object/bndbox/ymin/text()")).alias("ymin"), F.xpath("value", F.lit("annotation/object/bndbox/xmax/text()")).alias("xmax"), F.xpath("value", F.lit("annotation/object/bndbox/ymax/text()")).alias("ymax"), get("difficult").alias("difficult"))).alias("o"))
    num = lambda c: F.col(f"o.{c}").cast("double")
    return rows.select(F.regexp_extract("file", r"([^/]+)\.xml$", 1).alias("image"), F.col("o.name").alias("class"), (num("xmin") - 1).alias("x0"), (num("ymin") - 1).alias("y0"), num("xmax").alias("x1"), num("ymax").alias("y1"), F.coalesce(F.col("o.difficult").cast("int"), F.lit(0)).cast("boolean").alias("difficult"))


def read_cityscapes(spark: SparkSession, path: str) -> DataFrame:
    """file, label, order and polygon of polygon files; objects come later in front, so the order is reversed."""
    schema = "imgHeight int, imgWidth int, objects array<struct<label string, polygon array<array<double>>, deleted int>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    rows = doc.select("file", "imgHeight", "imgWidth", F.posexplode(F.reverse("objects")).alias("order", "o"))
    return rows.where(F.coalesce(F.col("o.deleted"), F.lit(0)) == 0).select("file", "imgHeight", "imgWidth", "order", F.col("o.label").alias("label"), F.col("o.polygon").alias("polygon"))


def instance_ids(pixels: DataFrame, value: str = "value") -> DataFrame:
    """label and crowd flag of instance pixels: from 1000 on the label is the thousands, below it's a crowd of the label itself."""
    v = F.col(value)
    return pixels.withColumn("label", F.when(v >= 1000, F.floor(v / 1000)).otherwise(v).cast("long")).withColumn("crowd", v < 1000)


def pair_files(images: DataFrame, truths: DataFrame, key: Column) -> DataFrame:
    """image and truth paths that share a stem."""
    left, right = images.select(key.alias("stem"), F.col("path").alias("image")), truths.select(key.alias("stem"), F.col("path").alias("truth"))
    return left.join(right, "stem").orderBy("stem")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def attach_proposals(images: DataFrame, proposals: DataFrame, limit: int | None = None) -> DataFrame:
    """images with their proposals (array<struct<score, box>>), best first; proposals join by the id as text."""
    rows = proposals.select(F.col("image_id").cast("string").alias("_id"), F.struct((-F.col("score")).alias("s"), "box").alias("p"))
    lists = rows.groupBy("_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    taken = F.col("p") if limit is None else F.slice("p", 1, limit)
    return images.withColumn("_id", F.col("image_id").cast("string")).join(lists, "_id", "left").withColumn("proposals", F.transform(taken, lambda x: F.struct((-x["s"]).alias("score"), x["box"].alias("box")))).drop("_id", "p")


def only_annotated(images: DataFrame, annotations: DataFrame, min_keypoints: int = 0) -> DataFrame:
    """Images with an object that isn't a crowd and, if asked for, enough visible keypoints: a semi-join."""
    kept = annotations.where(F.coalesce("iscrowd", F.lit(0)) == 0)
    if min_keypoints:
        seen = F.size(F.filter(F.transform("keypoints", lambda v, i: F.when(i % 3 == 2, v > 0)), lambda v: F.coalesce(v, F.lit(False))))
        kept = kept.groupBy("image_id").agg(F.sum(seen).alias("n")).where(F.col("n") >= min_keypoints)
    return images.join(kept.select(F.col("image_id").alias("id")), "id", "left_semi")


PANOPTIC = """
    annotations array<struct<image_id long, file_name string, segments_info array<struct<id long, category_id long, area double, bbox array<double>, iscrowd int>>>>,
    categories array<struct<id long, name string, isthing int>>
"""


def read_panoptic(spark: SparkSession, path: str, image_folder: str, truth_folder: str) -> tuple[DataFrame, DataFrame]:
    """Images (image_id, file_name, pan_seg_file_name, segments) of files in COCO's panoptic form, and the categories with `class` counted
    from 0 among things and among stuff. A segment's class is that of its category; a category that is unknown is an error."""
    doc = spark.read.schema(PANOPTIC).option("multiLine", True).json(path)
    named = doc.select(F.explode("categories").alias("c")).select("c.id", "c.name", (F.coalesce("c.isthing", F.lit(1)) == 1).alias("isthing")).distinct()
    if not at_most(named):
        raise ValueError("too many categories")
    categories = named.withColumn("class", F.row_number().over(Window.partitionBy("isthing").orderBy("id")).cast("long") - 1)
    rows = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.file_name", F.posexplode_outer("a.segments_info").alias("k", "s"))
    found = rows.join(F.broadcast(categories.select(F.col("id").alias("_c"), "class", "isthing")), F.col("s.category_id") == F.col("_c"), "left")
    bad = F.raise_error(F.concat(F.lit("unknown category "), F.col("s.category_id").cast("string"))).cast("long")
    kind = F.when(F.col("s").isNotNull() & F.col("class").isNull(), bad).otherwise(F.col("class"))
    segment = F.struct("k", F.col("s.id").alias("id"), kind.alias("class"), "isthing", F.col("s.area").alias("area"), F.col("s.bbox").alias("bbox"), F.coalesce("s.iscrowd", F.lit(0)).alias("iscrowd"))
    lists = found.groupBy("image_id", "file_name").agg(F.sort_array(F.collect_list(F.when(F.col("s").isNotNull(), segment))).alias("segments"))
    bare = F.regexp_replace("file_name", r"\.[^./]*$", "")
    images = lists.select("image_id", F.concat(F.lit(f"{image_folder}/"), bare, F.lit(".jpg")).alias("file_name"), F.concat(F.lit(f"{truth_folder}/"), F.col("file_name")).alias("pan_seg_file_name"), F.transform("segments", lambda s: s.dropFields("k")).alias("segments"))
    return images, categories


def segment_pixels(pixels: DataFrame) -> DataFrame:
    """segment of pixels (red, green, blue) of panoptic truth images: red + 256 green + 256^2 blue."""
    return pixels.withColumn("segment", (F.col("red").cast("long") + F.col("green").cast("long") * 256 + F.col("blue").cast("long") * 65536))


def visible_polygons(objects: DataFrame, reverse: bool = True) -> DataFrame:
    """Runs (file, order, label, y, x0, x1) of what can be seen of each object of read_cityscapes(): what the objects in front leave, front
    first by `order`. The painter's rule on runs, in place of cutting polygons from the union of those in front."""
    from tesserae.operators import masks

    keyed = objects.withColumn("id", F.xxhash64("file", "order"))
    runs = masks.from_polygons(keyed.select("id", F.transform("polygon", lambda p: p[0]).alias("xs"), F.transform("polygon", lambda p: p[1]).alias("ys")))
    # a file is an image of its own: its rows lie in a band of their own for the painter
    band = keyed.groupBy("file").agg(F.max("imgHeight").alias("h"))
    placed = written(band.withColumn("_k", F.sum("h").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))).select("file", F.coalesce("_k", F.lit(0)).cast("long").alias("top")), "bands")
    named = keyed.join(placed, "file").select("id", "file", "order", "label", "top")
    dealt = runs.join(named.select("id", "top"), "id").select("id", (F.col("y") + F.col("top")).alias("y"), "x0", "x1")
    seen = masks.paint_runs(dealt, named.select("id", (-F.col("order")).cast("double").alias("score")))
    back = seen.withColumnRenamed("label", "id").join(named, "id")
    return back.select("file", "order", "label", (F.col("y") - F.col("top")).alias("y"), "x0", "x1")


def merged_truths(detections: DataFrame, semantic: DataFrame, key: str = "file_name") -> DataFrame:
    """Detection rows with the semantic truth of the same file; a file without one is an error."""
    side = semantic.select(key, "sem_seg_file_name").dropDuplicates([key])
    out = detections.join(side, key, "left")
    bad = F.raise_error(F.concat(F.lit("no semantic truth for "), F.col(key)))
    return out.withColumn("sem_seg_file_name", F.when(F.col("sem_seg_file_name").isNull(), bad).otherwise(F.col("sem_seg_file_name")))
