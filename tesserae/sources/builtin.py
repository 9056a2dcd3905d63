"""Registrations of well-known datasets by their usual folders: names, files and metadata from rules over splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.sources import annotations
from tesserae.sources.registry import Catalog

# fixed values: years and splits, as the datasets are published
COCO_SPLITS = (("2014", "train"), ("2014", "val"), ("2014", "minival"), ("2014", "valminusminival"), ("2017", "train"), ("2017", "val"), ("2017", "test"), ("2017", "test-dev"), ("2017", "val_100"))
KEYPOINT_SPLITS = (("2014", "train"), ("2014", "val"), ("2014", "minival"), ("2014", "valminusminival"), ("2017", "train"), ("2017", "val"), ("2017", "val_100"))
PANOPTIC_SPLITS = ("train", "val", "val_100")
LVIS_SPLITS = (("v1", "train"), ("v1", "val"), ("v1", "test_dev"), ("v1", "test_challenge"), ("v0.5", "train"), ("v0.5", "val"), ("v0.5", "val_rand_100"), ("v0.5", "test"), ("v0.5", "train_cocofied"), ("v0.5", "val_cocofied"))
CITYSCAPES_SPLITS = ("train", "val", "test")
VOC_SPLITS = (("2007", "trainval"), ("2007", "train"), ("2007", "val"), ("2007", "test"), ("2012", "trainval"), ("2012", "train"), ("2012", "val"))
ADE_SPLITS = (("train", "training"), ("val", "validation"))


def _coco_file(kind: str, year: str, split: str) -> str:
    base, _, part = split.partition("_")
    if base.startswith("test"):
        return f"coco/annotations/image_info_{base}{year}.json"
    return f"coco/annotations/{kind}_{base}{year}{'_' + part if part else ''}.json"


def _coco_images(year: str, split: str) -> str:
    return f"coco/{next(x for x in ('train', 'val', 'test') if split.startswith(x) or split.startswith('mini') and x == 'val')}{year}"


def _instances(path: str, lvis: bool = False):
    return lambda spark: annotations.read_coco(spark, path, lvis)[2]


def _semantic(truths: str, images: str, truth_suffix: str, image_suffix: str):
    """image and truth paths that differ by folder and suffix only."""

    def load(spark):
        listed = lambda folder, suffix: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
        key = lambda suffix: F.regexp_replace(F.substring_index("path", "/", -1), f"{suffix.replace('.', '[.]')}$", "")
        left = listed(images, image_suffix).select(key(image_suffix).alias("stem"), F.col("path").alias("file_name"))
        return left.join(listed(truths, truth_suffix).select(key(truth_suffix).alias("stem"), F.col("path").alias("sem_seg_file_name")), "stem")

    return load


def register_builtin(catalog: Catalog, root: str, ade_truths: str = "annotations") -> list[str]:
    """Register all known splits below root; nothing is read before a dataset is asked for. Returns their names. ade_truths: the folder of
    ADE20K's truth images, which tools rename."""
    root = root.rstrip("/")
    before = set(catalog.names())
    for year, split in COCO_SPLITS:
        path = f"{root}/{_coco_file('instances', year, split)}"
        catalog.register(f"coco_{year}_{split}", _instances(path), json_file=path, image_root=f"{root}/{_coco_images(year, split)}", evaluator_type="coco")
    for year, split in KEYPOINT_SPLITS:
        path = f"{root}/{_coco_file('person_keypoints', year, split)}"
        catalog.register(f"keypoints_coco_{year}_{split}", _instances(path), json_file=path, image_root=f"{root}/{_coco_images(year, split)}", evaluator_type="coco")
    for split in PANOPTIC_SPLITS:
        base, _, part = split.partition("_")
        tail = f"{base}2017{'_' + part if part else ''}"
        path, images = f"{root}/coco/annotations/panoptic_{tail}.json", f"{root}/{_coco_images('2017', split)}"
        about = {"panoptic_json": path, "panoptic_root": f"{root}/coco/panoptic_{tail}", "image_root": images, "ignore_label": 255, "label_divisor": 1000, "evaluator_type": "coco_panoptic_seg"}
        catalog.register(f"coco_2017_{split}_panoptic", lambda spark, a=about: annotations.read_panoptic(spark, a["panoptic_json"], a["image_root"], a["panoptic_root"])[0], **about)
        stuff = f"{root}/coco/panoptic_stuff_{tail}"

        def separated(spark, split=split, stuff=stuff, images=images):
            held = catalog.get(spark, f"coco_2017_{split}")
            return annotations.merged_truths(held, _semantic(stuff, images, ".png", ".jpg")(spark))

        catalog.register(f"coco_2017_{split}_panoptic_separated", separated, sem_seg_root=stuff, evaluator_type="coco_panoptic_seg")
    for version, split in LVIS_SPLITS:
        path = f"{root}/lvis/lvis_{version}_{'image_info_' if split.startswith('test') else ''}{split}.json"
        catalog.register(f"lvis_{version}_{split}", _instances(path, True), json_file=path, image_root=f"{root}/coco/", evaluator_type="lvis")
    for split in CITYSCAPES_SPLITS:
        images, truths = f"{root}/cityscapes/leftImg8bit/{split}", f"{root}/cityscapes/gtFine/{split}"
        catalog.register(f"cityscapes_fine_instance_seg_{split}", lambda spark, t=truths: annotations.read_cityscapes(spark, f"{t}/*/*_polygons.json"), image_dir=images, gt_dir=truths, evaluator_type="cityscapes_instance")
        catalog.register(f"cityscapes_fine_sem_seg_{split}", _semantic(truths, images, "_gtFine_labelTrainIds.png", "_leftImg8bit.png"), image_dir=images, gt_dir=truths, ignore_label=255, evaluator_type="cityscapes_sem_seg")
    for year, split in VOC_SPLITS:
        folder = f"{root}/VOC{year}"

        def load(spark, folder=folder, split=split):
            names = spark.read.text(f"{folder}/ImageSets/Main/{split}.txt").select(F.trim("value").alias("image"))
            return annotations.read_voc(spark, f"{folder}/Annotations/*.xml").join(names, "image", "left_semi")

        catalog.register(f"voc_{year}_{split}", load, dirname=folder, split=split, year=int(year), evaluator_type="pascal_voc")
    for name, folder in ADE_SPLITS:
        images, truths = f"{root}/ADEChallengeData2016/images/{folder}", f"{root}/ADEChallengeData2016/{ade_truths}/{folder}"
        catalog.register(f"ade20k_sem_seg_{name}", _semantic(truths, images, ".png", ".jpg"), image_root=images, sem_seg_root=truths, ignore_label=255, evaluator_type="sem_seg")
    return sorted(set(catalog.names()) - before)
