"""Scalar functions as Columns. Those on arrays (ancestors, preview, clean_jsdoc, normalize_path, l2_distance) use lambdas,
which Spark interprets; all others stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that a scan prunes, besides those whose name begins with a dot.
IGNORED_DIRS = ("node_modules", "__pycache__", "venv", "env", "target", "dist", "build", "vendor")
#: Extension -> language.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "go": "go", "rb": "ruby"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def normalize_symbol_name(name: Column) -> Column:
    """Words of camel, Pascal, snake and kebab case and acronyms, in lower case, joined by a space."""
    parted = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=[\p{L}\p{N}])(?=\p{Lu}\p{Ll})", " ")
    return F.lower(F.trim(F.regexp_replace(parted, r"[^\p{L}\p{N}]+", " ")))


def simple_name(target: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(target, ".", -1)


def dirname(path: Column) -> Column:
    """What precedes the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last; none for a path without slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def like_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def match_tier(name: Column, query: Column) -> Column:
    """0: equal, 1: prefix, 2: otherwise; case doesn't count."""
    name, query = F.lower(name), F.lower(query)
    return F.when(name == query, 0).when(F.startswith(name, query), 1).otherwise(2)


def kind_penalty(kind: Column) -> Column:
    return F.when(kind.isin("function", "method", "class"), 0).when(kind == "import", 6).otherwise(3)


def kind_order(kind: Column) -> Column:
    return F.when(kind == "function", 0).when(kind == "method", 1).when(kind == "class", 2).otherwise(3)


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, line.cast("string"))


def header(path: Column, kind: Column, name: Column) -> Column:
    return F.concat(F.lit("// File: "), path, F.lit("\n// Type: "), kind, F.lit("\n// Name: "), name)


def content_slice(text: Column) -> Column:
    """The first 2,048 bytes of text in whole characters; null if under 50 bytes are left without the white space at its ends."""
    data = F.encode(text, "UTF-8")
    end = F.lit(2045)  # a character has four bytes at most, so one begins at 2,045 to 2,048
    for at in (2046, 2047, 2048):
        end = F.when(~F.hex(F.substring(data, at + 1, 1)).between("80", "BF"), at).otherwise(end)
    cut = F.when(F.octet_length(text) <= 2048, text).otherwise(F.decode(F.substr(data, F.lit(1), end), "UTF-8"))
    return F.when(F.octet_length(F.regexp_replace(cut, r"^[\x09-\x0D\x{85}\p{Z}]+|[\x09-\x0D\x{85}\p{Z}]+\z", "")) >= 50, cut)


def compact_text(head: Column, content: Column) -> Column:
    """The text that is embedded: the header and the content's first line."""
    return F.concat(head, F.lit("\n"), F.substring_index(content, "\n", 1))


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def preview(content: Column, lines: int = 3, indent: str = "    ") -> Column:
    """The first lines, indented."""
    return F.array_join(F.transform(F.slice(F.split(content, "\n"), 1, lines), lambda x: F.concat(F.lit(indent), x)), "\n")


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit("'\"`"))


def last_segment(path: Column, separator: str = "/") -> Column:
    return F.substring_index(path, separator, -1)


def is_ignored_dirname(name: Column) -> Column:
    return name.isin(*IGNORED_DIRS) | name.startswith(".")


def detect_language(path: Column) -> Column:
    """By extension; null for any other file."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for key, language in LANGUAGES.items():
        out = F.when(extension == key, language).otherwise(out)
    return out


def is_relevant_path(path: Column, root: str) -> Column:
    """A file of a known language under root, with no ignored directory on the way; its own name isn't tested."""
    below = F.substr(path, F.lit(len(root) + 2))
    dirs = F.split(dirname(below), "/")
    return F.startswith(path, F.lit(root + "/")) & detect_language(path).isNotNull() & ~F.exists(dirs, is_ignored_dirname)


def normalize_path(path: Column) -> Column:
    """. and .. resolved by text alone; a .. that nothing precedes is dropped."""
    step = lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def clean_jsdoc(comment: Column) -> Column:
    """A /** */ comment's lines without stars, and without those that begin with @, joined by a space."""
    body = F.regexp_replace(F.regexp_replace(comment, r"^\s*/\*\*?", ""), r"\*/\s*$", "")
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*?", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("@")), " ")


def starts_upper(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def visibility(name: Column, language: Column, modifiers: Column | None = None) -> Column:
    """By name: Python's underscores, Go's capitals, # and _ of JavaScript, Ruby's leading underscore. By modifiers, the
    words before a definition: Rust's pub, and private or protected of TypeScript and Ruby, which come first."""
    words = F.coalesce(F.lit("") if modifiers is None else modifiers, F.lit(""))
    said = F.when(words.rlike(r"\bprivate\b"), "private").when(words.rlike(r"\bprotected\b"), "protected")
    dunder = name.startswith("__") & name.endswith("__")
    python = F.when(dunder, "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")
    go = F.when(starts_upper(name), "public").otherwise("private")
    script = F.coalesce(said, F.when(name.startswith("#"), "private").when(name.startswith("_"), "protected").otherwise("public"))
    ruby = F.coalesce(said, F.when(name.startswith("_"), "private").otherwise("public"))
    rust = F.when(words.rlike(r"\bpub\b") | F.lit(modifiers is None), "public").otherwise("private")
    by_language = F.when(language == "python", python).when(language == "go", go).when(language.isin("javascript", "typescript", "tsx"), script)
    return by_language.when(language == "ruby", ruby).when(language == "rust", rust).otherwise("public")


def _accents() -> tuple[str, str]:
    """Letters up to U+024F that are one base letter with marks, and those base letters."""
    found = [(chr(c), d) for c in range(0xC0, 0x250) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def fold(text: Column) -> Column:
    """Lower case without accents of Latin letters; marks that stand alone go, too."""
    return F.regexp_replace(F.translate(F.lower(text), *_accents()), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def rrf_term(rank: Column, k: int = 60) -> Column:
    """Of a rank that counts from 0."""
    return 1 / (rank + k + 1)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x))


def dcg_discount(position: Column) -> Column:
    """Of a position that counts from 0."""
    return 1 / F.log2(position + F.lit(2.0))
