"""Rules of the corpus: generator families, protection, condition names. Column expressions and driver-side lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import CONDITIONS, GROUPS, first_rule

#: Architectures of the label files and the families that they belong to; any other is "other".
FAMILIES = {
    "SD": "sd", "Midjourney": "mj", "DALLE": "dalle", "ADM": "adm", "DDPM": "ddpm", "DDIM": "ddpm", "VQDM": "vqdm", "Imagen": "other",
    "BigGAN": "gan", "DF-GAN": "gan", "GALIP": "gan", "GigaGAN": "gan", "starGAN": "gan", "styleGAN": "gan", "VQGAN": "gan",
    "MAE": "other", "MAGE": "other", "VQVAE": "other",
}

#: What marks a row of a label file as protected.
PROTECTED_FILES = ["dalle2.csv", "dalle3.csv"]
PROTECTED_NAMES = ["DALLE"]
PROTECTED_FAMILY = "dalle"
PROTECTED_TOKENS = ["/dalle", "dall-e", "dall_e"]

#: Parts of a path that tell the family, the first that occurs.
PATH_TOKENS = [
    ("dalle", "dalle"), ("dall-e", "dalle"), ("dall_e", "dalle"), ("midjourney", "mj"), ("stable_diffusion", "sd"), ("/sd", "sd"), ("sdxl", "sd"),
    ("adm", "adm"), ("ddpm", "ddpm"), ("ddim", "ddpm"), ("vqdm", "vqdm"), ("glide", "glide"), ("flux", "flux"), ("gan_based", "gan"), ("gan", "gan"),
]

#: Other spellings of the conditions; the second table holds those that only result files use.
ALIASES = {
    "clean": "clean", "jpeg_q90": "jpeg_90", "jpeg_q70": "jpeg_70", "jpeg_q50": "jpeg_50", "jpeg_q30": "jpeg_30", "blur_0.5": "blur_05", "blur_1.0": "blur_10", "blur_2.0": "blur_20",
    "resize_0.5": "resize_050", "resize_0.25": "resize_025", "noise_0.02": "noise_002", "noise_0.05": "noise_005", "noise_0.10": "noise_010", "color_jitter_0.20": "jitter_pm20", "center_crop_0.80": "crop_80",
}
RESULT_ALIASES = {"resize_0.50": "resize_050", "jitter_20": "jitter_pm20"}
#: Fixed value: the condition beside the fifteen.
EXTRA_CONDITION = "crop_80_area"


def mapped(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def family_of(architecture: Column, is_fake: Column) -> Column:
    return F.when(~is_fake, "").otherwise(F.coalesce(mapped(architecture, FAMILIES), F.lit("other")))


def family_from_path(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(first_rule(*[(F.contains(low, F.lit(token)), family) for token, family in PATH_TOKENS]), F.lit("other"))


def protected_by(file: Column, architecture: Column, category: Column, is_fake: Column, key: Column) -> Column:
    """What protects a row: "file", "architecture", "category", "family" or "path", the first that holds; else null."""
    padded = F.concat(F.lit("/"), key)
    in_path = F.lit(False)
    for token in PROTECTED_TOKENS:
        in_path = in_path | F.contains(padded, F.lit(token))
    return first_rule(
        (file.isin(PROTECTED_FILES), "file"), (F.upper(architecture).isin(PROTECTED_NAMES), "architecture"), (F.upper(category).isin(PROTECTED_NAMES), "category"),
        (family_of(architecture, is_fake) == PROTECTED_FAMILY, "family"), (in_path, "path"),
    )


def canonical(name: Column, strict: bool = False) -> Column:
    """The condition's own name; other names pass, or raise an error if `strict` (where only the first table of aliases counts)."""
    known = F.when(name.isin([*CONDITIONS, EXTRA_CONDITION]), name)
    if strict:
        return F.coalesce(known, mapped(name, ALIASES), F.raise_error(F.concat(F.lit("unknown condition "), name)).cast("string"))
    return F.coalesce(known, mapped(name, ALIASES | RESULT_ALIASES), name)


def resolve_conditions(spec: str) -> list[str]:
    """Conditions of "all", "group:name", a group's name or a comma-separated list in any spelling."""
    spec = spec.strip()
    name = spec.removeprefix("group:")
    if spec == "all":
        return list(CONDITIONS)
    if name in GROUPS:
        return list(GROUPS[name])
    if spec.startswith("group:"):
        raise ValueError(f"unknown group {name!r}; known: {sorted(GROUPS)}")
    known = {c: c for c in [*CONDITIONS, EXTRA_CONDITION]} | ALIASES
    asked = [c.strip() for c in spec.split(",") if c.strip()]
    if unknown := [c for c in asked if c not in known]:
        raise KeyError(f"unknown conditions {unknown}")
    return [known[c] for c in asked]


def wanted_conditions(more: list[str]) -> list[str]:
    """The fifteen, then further ones that were asked for by any spelling."""
    known = {c: c for c in CONDITIONS} | ALIASES | RESULT_ALIASES
    return list(dict.fromkeys([*CONDITIONS, *[known.get(c, c) for c in more]]))
