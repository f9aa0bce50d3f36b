"""Settings of a run, checked once, and the command line that makes them."""

from __future__ import annotations

import argparse
import configparser
from dataclasses import dataclass, field, fields

METHODS = ("center", "random", "stride")
STATUSES = ("negative", "positive", "unknown")
SEQUENCES = ("T2W", "bpMRI")
#: Names that mean the same output kind.
FORMATS = {"npy": "npy", "nmp": "npy", "npm": "npy", "jpg": "jpg", "png": "png", "tiff": "tiff", "parquet": "parquet"}


#: The numbers of pixel types that the original's reader fills with.
PIXEL_TYPES = {"i1": 0, "u1": 1, "i2": 2, "u2": 3, "i4": 4, "u4": 5, "f4": 8, "f8": 9}


@dataclass(frozen=True)
class Params:
    crop_method: str = "center"
    patient_status: str = "negative"
    sequence_type: str = "T2W"
    pixel_spacing: float = 0.5
    crop_image_size: int = 128
    crop_stride: int = 32
    sample_number: int = 12
    tumor_label_level: int = 2
    gland_contains_lesion: bool = False
    normalized_image: bool = True
    normalized_vmax: float = 242.0
    do_normalization: bool = False
    max_percentile: float = 99.5
    saved_image_type: str = "png"
    c_min_positive: float = 0.2
    c_min_negative: float = 1.0
    min_overlap_percent: float = 50.0
    exclude_slices: int = 1
    keep_all_slices: bool = True
    #: What lies outside of a slice after resampling: a number, or the usual: the pixel type's number in "reference", 0 in "strict".
    fill: float | None = None
    seed: int = 42
    #: "reference" begins one slice late, keeps partial edge crops with three modalities and takes the nearest
    #: pixel for ADC and HBV of centred and random negatives; "strict" does none of these.
    compat: str = "reference"
    #: Windows are placed by the gland's largest outline, or by the gland's own extents.
    geometry: str = "contour"
    #: What random windows are drawn by, and how positives are drawn: see ``windows.sampled``.
    draw: str = "hash"
    positive_draws: str = "acceptable"
    keywords: dict = field(default_factory=lambda: {"T2W": "T2W", "ADC": "ADC", "HBV": "HBV"})

    def __post_init__(self):
        for name, known in (("crop_method", METHODS), ("patient_status", STATUSES), ("sequence_type", SEQUENCES), ("saved_image_type", FORMATS), ("compat", ("reference", "strict")), ("geometry", ("contour", "extents")), ("draw", ("hash", "lcg")), ("positive_draws", ("acceptable", "attempts"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")
        if self.crop_image_size < 1 or self.crop_stride < 1 or self.pixel_spacing <= 0:
            raise ValueError("sizes and spacing must be positive")

    @property
    def file_type(self) -> str:
        return FORMATS[self.saved_image_type]

    def fill_of(self, src_dtype: str) -> float:
        """What stands for pixels outside of a slice of this stored type."""
        if self.fill is not None:
            return self.fill
        return float(PIXEL_TYPES[src_dtype]) if self.compat == "reference" else 0.0

    @property
    def positive(self) -> bool:
        return self.patient_status == "positive"

    @property
    def modalities(self) -> list[str]:
        return ["T2W"] if self.sequence_type == "T2W" else ["T2W", "ADC", "HBV"]


def read_keywords(path: str) -> dict:
    """Modality names of an INI file's ``[config]`` part; the usual ones where it says nothing."""
    ini = configparser.ConfigParser()
    ini.read(path)
    return {k: ini.get("config", k, fallback=k) for k in ("T2W", "ADC", "HBV")}


#: Paths that the command line takes beside the settings.
PATHS = ("orig_img_path_t2w", "orig_img_path_adc", "orig_img_path_hbv", "seg_img_path", "seg_img_path_lesion", "path_to_save")


def parse_all(argv: list[str] | None = None) -> tuple[Params, dict[str, str | None]]:
    """Settings and paths from a command line; ``--keep-all-slices false`` means false."""
    parser = argparse.ArgumentParser(prog="patchwell", description="Patches from image volumes")
    for name in PATHS:
        parser.add_argument("--" + name.replace("_", "-"))
    for f in fields(Params):
        if f.name == "keywords":
            parser.add_argument("--config")
            continue
        kind = {"bool": lambda s: s.lower() in ("1", "true", "yes"), "int": int, "float": float, "float | None": float}.get(f.type, str)
        parser.add_argument("--" + f.name.replace("_", "-"), type=kind, default=f.default)
    given = vars(parser.parse_args(argv))
    config, paths = given.pop("config"), {name: given.pop(name) for name in PATHS}
    return Params(**given, **({"keywords": read_keywords(config)} if config else {})), paths


def parse(argv: list[str] | None = None) -> Params:
    return parse_all(argv)[0]
