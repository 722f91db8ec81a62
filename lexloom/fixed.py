"""Word lists, tables and constants that must equal the reference's for results to be right.

They are stated here together, as they are; nothing else in the package repeats them.
"""

from __future__ import annotations

# Words that are no concepts, by language.
_PYTHON = """
and as assert async await break class continue def del elif else except finally for from global if import in is lambda
nonlocal not or pass raise return try while with yield
int float str bool list dict set tuple none true false bytes complex object type
self cls super
""".split()
_SCRIPT = """
const let var function class if else for while do switch case break continue return try catch finally throw new this
typeof instanceof void delete in of import export default from as async await
string number boolean null undefined object any never unknown symbol bigint array promise map set
""".split()
_RUST = """
fn let mut const static struct enum impl trait type pub crate mod use self super where for in if else match loop while
break continue return async await move ref unsafe
bool char str string i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 vec box option result some none ok err
""".split()
STOP_WORDS = {"python": frozenset(_PYTHON), "typescript": frozenset(_SCRIPT), "javascript": frozenset(_SCRIPT), "rust": frozenset(_RUST)}

# What prefixes and suffixes of identifiers stand for.
PREFIX_ROLES = {"nb_": "count", "is_": "boolean predicate", "has_": "boolean predicate", "n_": "count", "num_": "count"}
PREFIX_DEFAULT = "prefix pattern"
SUFFIX_ROLES = {
    "_count": "count", "_mask": "binary mask", "_map": "mapping", "_list": "collection", "_path": "file path",
    "_size": "dimension size", "_shape": "tensor shape", "_idx": "index", "_fn": "callable",
}
SUFFIX_DEFAULT = "suffix pattern"
CAMEL_ROLES = {"use": "React hook", "on": "event handler", "handle": "event handler implementation", "get": "accessor", "set": "mutator", "to": "conversion"}

# Words of a description that mean a role.
ROLE_SYNONYMS = {"count": "count", "number": "count", "boolean": "boolean predicate", "flag": "boolean predicate", "convert": "conversion", "conversion": "conversion"}

# Pairs of words that contrast by themselves.
KNOWN_CONTRASTS = (
    ("source", "target"), ("src", "trg"), ("input", "output"), ("pred", "true"), ("before", "after"),
    ("left", "right"), ("fixed", "moving"), ("old", "new"), ("expected", "actual"), ("query", "key"),
)

# Folders that do not count when languages are detected (hidden ones never do), and what a
# folder's path holds that is passed over when a commit's tree is read.
DETECT_SKIPPED = ("node_modules", "__pycache__", "dist", "venv", "target")
TREE_SKIPPED = ("__pycache__", ".git/", "venv/", ".venv/", "node_modules/", "site-packages/", ".tox/", ".eggs/", "egg-info/", "dist/", ".next/")

# Globs of the files of a language, and of those left out.
DEFAULT_GLOBS = {
    "python": (["**/*.py"], ["**/test_*", "**/__pycache__"]),
    "typescript": (["**/*.ts", "**/*.tsx"], ["**/node_modules", "**/dist", "**/.next", "**/*.d.ts", "**/*.test.ts", "**/*.spec.ts"]),
    "javascript": (["**/*.js", "**/*.jsx"], ["**/node_modules", "**/dist", "**/.next", "**/*.test.js", "**/*.spec.js"]),
    "rust": (["**/*.rs"], ["**/target/**", "**/tests/**", "**/benches/**", "**/build.rs"]),
}
