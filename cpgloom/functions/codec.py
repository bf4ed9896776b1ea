"""Value codec, track keys and the scalar helpers used by the operators."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_MAX = 10000
COVERAGE_MAX = 65534


@dataclass(frozen=True, order=True)
class TrackKey:
    assay: str
    haplotype: str
    strand: str

    def __str__(self) -> str:
        return "__".join((self.assay, self.haplotype, self.strand))

    @classmethod
    def parse(cls, text: str) -> TrackKey:
        parts = text.split("__", 2)
        if len(parts) != 3 or not all(parts):
            raise ValueError(f"not a track key: {text!r}")
        return cls(*parts)


def view_name(assay: Column, haplotype: Column, strand: Column) -> Column:
    return F.concat_ws("__", assay, haplotype, strand)


def encode_percent(percent: Column) -> Column:
    """Percent to hundredths, in single precision, half to even; null outside 0..100 and for NaN."""
    p = percent.cast("float")
    return F.when((p >= 0) & (p <= 100), F.rint(p * F.lit(100).cast("float")).cast("int"))


def encode_fraction(x: Column) -> Column:
    """Fraction to ten-thousandths; tolerates 1e-6 beyond 0..1, null further out."""
    inside = (x >= -1e-6) & (x <= 1 + 1e-6)
    return F.when(inside, F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * VALUE_MAX).cast("int"))


def reencode_percent(percent: Column) -> Column:
    """The path of callers that report percent without coverage: to a single-precision fraction,
    clipped, and back to hundredths."""
    f = (percent.cast("double") / 100).cast("float")
    f = F.least(F.greatest(f, F.lit(0).cast("float")), F.lit(1).cast("float"))
    return F.rint((f * F.lit(100).cast("float")).cast("float") * F.lit(100).cast("float")).cast("int")


def decode_fraction(v: Column) -> Column:
    return v / F.lit(float(VALUE_MAX))


def decode_percent(v: Column) -> Column:
    return v / F.lit(100.0)


def is_finite(c: Column) -> Column:
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def rounded_mean(total: Column, n: Column) -> Column:
    """Mean of integer numerators, half to even, clipped to the value range; null for no cells."""
    mean = total.cast("double") / F.nullif(n, F.lit(0)).cast("double")
    return F.rint(F.least(F.greatest(mean, F.lit(0.0)), F.lit(float(VALUE_MAX)))).cast("int")


def shift_minus(position: Column, strand: Column, clamp: bool) -> Column:
    """Minus-strand calls sit one base to the right of their CpG. ``clamp`` keeps a call at 0 there;
    otherwise it has no place."""
    moved = position - 1
    moved = F.greatest(moved, F.lit(0)) if clamp else F.when(moved >= 0, moved)
    return F.when(strand == "-", moved).otherwise(position)


#: Fixed: groups of tissues by the beginning of their name, in lower case.
BROAD_TISSUES = {
    "brain": "Brain / CNS",
    "skin": "Skin / Connective",
    "muscle": "Musculoskeletal",
    "heart": "Cardiovascular",
    "aorta": "Cardiovascular",
    "blood": "Blood / Immune",
    "lung": "Respiratory",
    "colon": "Digestive",
    "esophagus": "Digestive",
    "liver": "Digestive",
    "adrenal": "Endocrine",
    "ovary": "Reproductive",
    "testis": "Reproductive",
}
#: Fixed: words anywhere in a name that decide before the table does, except for names it puts first.
BROAD_WORDS = {"dermal fibroblast": "Skin / Connective"}


def broad_tissue(name: Column, prefixes: dict[str, str] = BROAD_TISSUES, words: dict[str, str] = BROAD_WORDS, other: str = "Other") -> Column:
    """Group of a tissue name by its beginning or a word in it; blank names have none. The first prefix wins
    over the words, which win over the others."""
    n = F.lower(F.trim(name))
    first, *rest = prefixes.items()
    out = F.lit(other)
    for prefix, group in reversed(rest):
        out = F.when(n.startswith(prefix), group).otherwise(out)
    for word, group in words.items():
        out = F.when(n.contains(word), group).otherwise(out)
    return F.when(n != "", F.when(n.startswith(first[0]), first[1]).otherwise(out))


#: Fixed: the pattern of a sample's root within its id, the parts it has otherwise, and endings that do not count.
SAMPLE_ROOT = r"^(SMHT[^-]+(?:-[^-]+){5})"
STORE_ENDINGS = r"\.(?:smdb|mmdb|mdb|bam|bai)$"


def canonical_root(c: Column) -> Column:
    """The root of a sample id or path: its last part without endings, cut to the pattern where it fits; empty
    for a blank or missing one."""
    base = F.regexp_replace(F.regexp_extract(F.trim(c), r"([^/]*)$", 1), STORE_ENDINGS, "")
    root = F.regexp_extract(base, SAMPLE_ROOT, 1)
    return F.when(c.isNull() | F.lower(F.trim(c)).isin("", "nan"), "").when(root != "", root).otherwise(base)


def thousands_label(rank: Column, chrom: Column, start: Column, end: Column) -> Column:
    """``H<rank>: <chrom>:<first>-<last>`` with 1-based, comma-grouped positions of a half-open interval."""
    return F.concat(F.lit("H"), rank.cast("string"), F.lit(": "), chrom, F.lit(":"), F.format_number(start + 1, 0), F.lit("-"), F.format_number(end, 0))


_SUFFIXES = re.compile(r"(\.(bed|bedmethyl|tsv|txt|smdb|segments|gz|combined|hap1|hap2|hp1|hp2))+$", re.IGNORECASE)


def sample_id_from_path(path: str) -> str:
    return _SUFFIXES.sub("", path.rstrip("/").rsplit("/", 1)[-1])


def safe_file_part(c: Column) -> Column:
    """A category as part of a file name: no slashes, blanks or commas."""
    return F.translate(c, "/ ,", "__")


@dataclass(frozen=True)
class Region:
    """Half-open region; ``end`` None is a single position."""

    chrom: str
    start: int
    end: int


def parse_inclusive_region(text: str, commas: bool = False) -> Region:
    """``chrom:lo-hi``, 0-based with both ends in (lookups; plots also allow thousands commas)."""
    digits = r"[\d,]+" if commas else r"\d+"
    m = re.fullmatch(rf"([^\s:]+):({digits})-({digits})", text.strip() if commas else text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    lo, hi = (int(x.replace(",", "")) for x in m.groups()[1:])
    if hi < lo:
        raise ValueError("the end of a region lies before its start")
    return Region(m.group(1), lo, hi + 1)


def parse_locus(text: str) -> Region:
    m = re.fullmatch(r"([^\s:]+):(\d+)", text)
    if not m:
        raise ValueError(f"not a position: {text!r}")
    return Region(m.group(1), int(m.group(2)), int(m.group(2)) + 1)


def parse_half_open_region(text: str) -> Region:
    """``chrom:start-end``, 0-based half-open, digits only (exports)."""
    m = re.fullmatch(r"([^\s:]+):([0-9]+)-([0-9]+)", text)
    if not m or int(m.group(2)) >= int(m.group(3)):
        raise ValueError(f"not a half-open region: {text!r}")
    return Region(m.group(1), int(m.group(2)), int(m.group(3)))
