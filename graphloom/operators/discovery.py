"""Which files of a corpus are read: predicates over paths, sizes and content, and large-folder pruning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders always left out, folder names of generated files, name parts of generated files, limits.
SKIPPED = (
    ".git", ".ci-cargo", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", "DerivedData", ".tox", ".mypy_cache", ".pytest_cache", "eggs", ".eggs", "_build", "deps",
)
GENERATED_FOLDERS = (".cache", ".generated", ".next", ".nuxt", ".parcel-cache", ".turbo", "cache", "generated", "vendor")
GENERATED_PARTS = (".generated.", ".min.", ".bundle.", ".map")
MAX_FILE_BYTES, SNIFF, MAX_FILES, MAX_BYTES, SAMPLE, GENERATED_SHARE = 1_048_576, 8192, 10_000, 536_870_912, 64, 0.8
# Languages by extension.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "rs": "rust", "swift": "swift",
    "ex": "elixir", "exs": "elixir", "sh": "bash", "bash": "bash", "css": "css", "go": "go",
}


def skipped(path: Column) -> Column:
    """Whether any folder of the path is always left out."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(s) for s in SKIPPED]))


def is_text(content: Column) -> Column:
    """Whether the first bytes hold no NUL and are valid UTF-8; a character cut at their end isn't."""
    head = F.substring(content, 1, SNIFF)
    return F.is_valid_utf8(head.cast("string")) & ~F.contains(head.cast("string"), F.lit("\0"))


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def language(path: Column, content: Column | None = None) -> Column:
    """The language by extension; text for other texts, null for what isn't text."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    found = F.try_element_at(known, extension(path))
    return found if content is None else F.coalesce(found, F.when(is_text(content), F.lit("text")))


def generated_name(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit(False)
    for part in GENERATED_PARTS:
        out = out | F.contains(name, F.lit(part))
    return out


def pruned_folders(folders: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Folders (folder, files, bytes, generated) too large to read that look generated."""
    large = (F.col("files") > max_files) | (F.col("bytes") > max_bytes)
    named = F.arrays_overlap(F.split("folder", "/"), F.array(*[F.lit(s) for s in GENERATED_FOLDERS]))
    return folders.filter(large & (named | (F.col("generated") >= GENERATED_SHARE))).select("folder")


def generated_around(paths: DataFrame, children: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Paths below a folder that is too large by its own files alone and looks generated: the rule for a single file.

    children: folders by their direct children. Unlike pruned_folders() a folder's files count in it only.
    """
    from graphloom.operators.lookup import ancestors

    large = pruned_folders(children, max_files, max_bytes)
    return paths.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).filter("folder <> path").join(large, "folder", "left_semi").select("path").distinct()


def ignore_rules(text: str) -> list[tuple[str, bool, bool]]:
    """An ignore file's rules in order: (pattern of whole paths, whether it is an exception, whether only folders match)."""
    out = []
    for line in text.splitlines():
        rule = line.rstrip() if not line.endswith("\\ ") else line
        if not rule or rule.startswith("#"):
            continue
        exception = rule.startswith("!")
        rule = rule[1:] if exception else rule.removeprefix("\\")
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        rule = rule.removeprefix("/")
        body, k = "", 0
        while k < len(rule):
            if rule.startswith("**/", k) and (k == 0 or rule[k - 1] == "/"):
                body, k = body + "(?:.*/)?", k + 3
            elif rule[k:] == "**" and (k == 0 or rule[k - 1] == "/"):
                body, k = body + ".+", k + 2
            elif rule[k] == "*":
                body, k = body + "[^/]*", k + 1
            elif rule[k] == "?":
                body, k = body + "[^/]", k + 1
            elif rule[k] == "[" and (end := rule.find("]", k + 2)) > 0:
                inner = rule[k + 1 : end]
                body, k = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            elif rule[k] == "\\" and k + 1 < len(rule):
                body, k = body + re.escape(rule[k + 1]), k + 2
            else:
                body, k = body + re.escape(rule[k]), k + 1
        if body:
            out.append((f"^{'' if anchored else '(?:.*/)?'}{body}$", exception, folder))
    return out


def ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a path is ignored: the last rule that matches decides; what is in an ignored folder can't be excepted."""
    from graphloom.operators.lookup import ancestors

    def decided(at: Column, folders: bool) -> Column:
        out = F.lit(False)
        for pattern, exception, folder in rules:
            if folders or not folder:
                out = F.when(at.rlike(pattern), F.lit(not exception)).otherwise(out)
        return out

    above = F.filter(ancestors(path), lambda a: a != path)
    return F.exists(above, lambda a: decided(a, True)) | decided(path, False)


def outside(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files that are in none of the folders, at any depth: an anti-join over their exploded ancestors."""
    from graphloom.operators.lookup import ancestors

    inside = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(folders, "folder", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti")


def discovered(files: DataFrame, max_size: int = MAX_FILE_BYTES, ignored: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """Files (path, content, size) to read: rel_path, language, byte_size, content_hash, by path."""
    kept = files.filter(~skipped(F.col("path")) & (F.col("size") <= max_size))
    if ignored is not None:
        kept = kept.join(ignored.select("path"), "path", "left_anti")
    if folders is not None:
        kept = outside(kept, folders)
    kept = kept.filter(is_text(F.col("content"))).withColumn("language", language(F.col("path"), F.col("content"))).filter("language is not null")
    return kept.select(F.col("path").alias("rel_path"), "language", F.col("size").alias("byte_size"), F.sha2("content", 256).alias("content_hash"))
