"""``python -m patchwell``: crops of the volumes that the command line names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .params import parse_all
from .plans.run import run


def main(argv: list[str] | None = None) -> int:
    params, paths = parse_all(argv)
    if not paths["seg_img_path"] or not paths["path_to_save"]:
        raise SystemExit("--seg-img-path and --path-to-save are needed")
    spark = SparkSession.builder.appName("patchwell").getOrCreate()
    images = {m: paths[f"orig_img_path_{m.lower()}"] for m in params.modalities}
    print(run(spark, params, images, paths["seg_img_path"], paths["seg_img_path_lesion"], paths["path_to_save"]).count(), "files")
    return 0


if __name__ == "__main__":
    main()
