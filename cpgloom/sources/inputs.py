"""What command-line inputs stand for: stores, matrix folders, segment tables, lists of files and samples."""

from __future__ import annotations

import glob
import json
import os

from ..functions.codec import sample_id_from_path
from .arrays import PREFERRED
from .store import MANIFEST

SEGMENTS = (".segments.bed", ".segments.bed.gz")


def list_lines(path: str) -> list[str]:
    """Lines of a list, without blank ones and comments."""
    with open(path) as f:
        return [x.strip() for x in f if x.strip() and not x.startswith("#")]


def split_values(values: list[str] | None, path: str | None = None) -> list[str]:
    """Sample ids from repeated or comma-separated values and from a file with one id per line; each once, in
    order."""
    out = [t.strip() for v in values or [] for t in v.split(",")]
    out += list_lines(path) if path else []
    return list(dict.fromkeys(x for x in out if x))


def kind_of(path: str) -> str:
    """``bundle``, ``cohort``, ``matrix`` (a folder with a dense matrix) or ``unknown``."""
    manifest = os.path.join(path, MANIFEST)
    if os.path.isfile(manifest):
        with open(manifest) as f:
            return json.load(f).get("kind", "unknown")
    return "matrix" if any(os.path.isfile(os.path.join(path, f"{m}.npy")) for m in PREFERRED) else "unknown"


def expand(tokens: list[str]) -> list[str]:
    """Paths, patterns and ``.txt`` lists; each path once, in order."""
    out: list[str] = []
    for t in map(os.path.expanduser, tokens):
        out += expand(list_lines(t)) if t.endswith(".txt") and os.path.isfile(t) else sorted(glob.glob(t)) or [t]
    return list(dict.fromkeys(map(os.path.abspath, out)))


def find_stores(tokens: list[str]) -> tuple[list[str], str | None]:
    """(bundles, cohort) behind paths; a folder that is no store stands for the bundles in it. Both kinds at
    once, several cohorts, or none of either are errors."""
    bundles, cohorts = [], []
    for p in expand(tokens):
        kind = kind_of(p) if os.path.isdir(p) else "unknown"
        if kind == "bundle":
            bundles.append(p)
        elif kind == "cohort":
            cohorts.append(p)
        elif os.path.isdir(p):
            bundles += [c for c in sorted(glob.glob(os.path.join(p, "*"))) if os.path.isdir(c) and kind_of(c) == "bundle"]
    bundles = list(dict.fromkeys(bundles))
    if len(cohorts) > 1 or cohorts and bundles:
        raise ValueError("give bundles or one cohort")
    if not cohorts and not bundles:
        raise FileNotFoundError(f"no store at {tokens}")
    return bundles, cohorts[0] if cohorts else None


def find_segments(tokens: list[str]) -> dict[str, str]:
    """Segment tables by sample id, from files, folders (one level deep), patterns and lists; each file once."""
    found: dict[str, str] = {}
    for p in expand(tokens):
        files = [p] if os.path.isfile(p) else sorted({f for end in SEGMENTS for d in ("*", os.path.join("*", "*")) for f in glob.glob(os.path.join(p, d)) if f.endswith(end)})
        if not files:
            raise FileNotFoundError(f"no segment table at {p}")
        for f in map(os.path.realpath, files):
            name = sample_id_from_path(f)
            if found.setdefault(name, f) != f:
                raise ValueError(f"two segment tables of sample {name}: {found[name]} and {f}")
    return found


def named_files(path: str) -> list[tuple[str, str]]:
    """``(sample, file)`` of a list of paths or of ``sample<TAB>path`` lines."""
    parts = [x.split("\t") for x in list_lines(path)]
    return [(os.path.basename(p[0]), p[0]) if len(p) == 1 else (p[0], p[1]) for p in parts]
