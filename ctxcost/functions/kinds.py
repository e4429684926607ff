"""What kind of file a path and its first bytes stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

SNIFF_BYTES = 512

LOCKFILES = frozenset("Cargo.lock Gemfile.lock composer.lock go.sum package-lock.json pnpm-lock.yaml poetry.lock yarn.lock".split())
BUILD_DIRS = frozenset("build dist generated out target .next".split())
WRITTEN_DIRS = frozenset("migrations snapshots __snapshots__".split())
VENDOR_DIRS = frozenset("node_modules third_party vendor".split())
FIXTURE_DIRS = frozenset("fixtures snapshots testdata __fixtures__ __snapshots__".split())
DOC_EXTENSIONS = frozenset(f".{x}" for x in "adoc md mdx rst txt".split())
_IMAGES = "bmp gif ico jpeg jpg png webp"
_FONTS = "eot otf ttf woff woff2"
_ARCHIVES = "7z gz rar tar zip"
_PROGRAMS = "db dll dylib exe node pdf so sqlite wasm"
BINARY_EXTENSIONS = frozenset(f".{x}" for x in f"{_IMAGES} {_FONTS} {_ARCHIVES} {_PROGRAMS}".split())
_WEB = "cjs css html js json jsx mjs scss ts tsx"
_NATIVE = "c cpp cs go h hpp java kt rs scala swift"
_SCRIPTS = "php ps1 py rb sh toml yaml yml"
SOURCE_EXTENSIONS = frozenset(f".{x}" for x in f"{_WEB} {_NATIVE} {_SCRIPTS}".split())
GRAPH_EXTENSIONS = tuple(f".{x}" for x in "cjs js jsx mjs ts tsx".split())

_ENTRY_STEMS = {"index": "cjs js mjs ts", "bin": "cjs js mjs ts", "cli": "js mjs ts", "main": "go js py rs ts", "app": "js ts", "server": "js ts"}
ENTRYPOINT_NAMES = frozenset({"__init__.py", *(f"{stem}.{x}" for stem, xs in _ENTRY_STEMS.items() for x in xs.split())})
RESIDENT_NAMES = frozenset((".cursorrules", "AGENTS.md", "CLAUDE.local.md", "CLAUDE.md"))


def _in(x: Column, names: frozenset[str]) -> Column:
    return x.isin(sorted(names))


def _under(path: Column, names: frozenset[str]) -> Column:
    return F.arrays_overlap(paths.directories(path), F.array(*(F.lit(n) for n in sorted(names))))


def is_minified(path: Column) -> Column:
    return path.rlike(r"(?i)\.min\.[^/]+$")


def is_generated_path(path: Column) -> Column:
    return _in(paths.basename(path), LOCKFILES) | is_minified(path) | path.rlike(r"\.pb\.(?:cc|go|h|js)$") | _under(path, BUILD_DIRS | WRITTEN_DIRS)


def needs_sniff(path: Column) -> Column:
    """Whether the path alone can't decide the kind, so that the first bytes must be read."""
    known = _in(paths.extension(path), BINARY_EXTENSIONS | DOC_EXTENSIONS | SOURCE_EXTENSIONS)
    return ~(known | is_generated_path(path) | _under(path, BUILD_DIRS | VENDOR_DIRS | FIXTURE_DIRS))


def looks_binary(sample: Column) -> Column:
    """A zero byte, or more than three tenths control bytes, in a BINARY sample; false for none or an empty one."""
    text = F.hex(sample)
    size = F.octet_length(sample)
    control = F.length(F.regexp_replace(text, "(0[0-6]|0F|1[0-9ACDEF])|..", "$1")) / 2
    zero = text.rlike("^(..)*00")
    return F.coalesce((size > 0) & (zero | (control / size > 0.3)), F.lit(False))


def classify(path: Column, sample: Column | None = None) -> Column:
    ext = paths.extension(path)
    out = F.when(_in(ext, BINARY_EXTENSIONS), "binary")
    if sample is not None:
        out = out.when(looks_binary(sample), "binary")
    return out.when(is_generated_path(path), "generated").when(_under(path, VENDOR_DIRS), "vendored").when(_under(path, FIXTURE_DIRS), "fixture").when(_in(ext, DOC_EXTENSIONS), "doc").otherwise("source")


def is_entrypoint(path: Column, tier: Column) -> Column:
    """By name: a resident file, a usual entry file, a test or a benchmark."""
    base = paths.basename(path)
    return (tier == 0) | _in(base, ENTRYPOINT_NAMES) | base.rlike(r"\.(?:test|spec)\.[jt]sx?$") | base.rlike(r"\.bench\.[cm]?[jt]sx?$")


def is_graph_eligible(path: Column) -> Column:
    return paths.extension(path).isin(*GRAPH_EXTENSIONS)


def is_resident_name(path: Column) -> Column:
    return _in(paths.basename(path), RESIDENT_NAMES)
