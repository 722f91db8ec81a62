"""Identifier and annotation functions, as native column expressions unless the name says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..fixed import CAMEL_ROLES, PREFIX_DEFAULT, PREFIX_ROLES, STOP_WORDS, SUFFIX_DEFAULT, SUFFIX_ROLES


def stop_words(languages: str) -> set[str]:
    """The union for comma-joined languages; unknown ones have none."""
    return set().union(*(STOP_WORDS.get(x.strip(), set()) for x in languages.split(",")))


def split_identifier(name: Column | str) -> Column:
    """Lower-case subtokens, cut at underscores and where case changes; a digit is not cut off."""
    c = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"([\p{Ll}0-9])(\p{Lu})", "$1_$2")
    c = F.regexp_replace(c, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    return F.filter(F.split(F.lower(c), "_"), lambda x: x != "")


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the needle's characters occur in the other in order."""
    return F.aggregate(F.split(hay, ""), F.lit(1), lambda i, c: F.when(F.substring(needle, i, 1) == c, i + 1).otherwise(i)) > F.length(needle)


def abbreviation_class(short: Column, long: Column) -> Column:
    """0: a proper prefix; 1: a subsequence with the same first letter and at least a third of the length; else null."""
    a, b = F.lower(short), F.lower(long)
    shorter = (F.length(a) > 0) & (F.length(a) < F.length(b))
    loose = (F.length(a) >= 2) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.length(a) * 3 >= F.length(b)) & is_subsequence(a, b)
    return F.when(shorter & F.startswith(b, a), F.lit(0)).when(shorter & loose, F.lit(1))


def find_abbreviation(short: str, candidates: list[str]) -> str | None:
    """The driver-side form for one word: the best class, then the shortest, then the first."""
    s, best = short.lower(), None
    for i, c in enumerate(candidates):
        low = c.lower()
        if not s or len(s) >= len(low):
            continue
        it = iter(low)
        kind = 0 if low.startswith(s) else 1 if len(s) >= 2 and s[0] == low[0] and 3 * len(s) >= len(low) and all(x in it for x in s) else None
        if kind is not None and (best is None or (kind, len(c), i) < best[:3]):
            best = (kind, len(c), i, c)
    return best[3] if best else None


def _role(table: dict[str, str], key: Column, default: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(known, key), F.lit(default))


def prefix_role(prefix: Column) -> Column:
    return _role(PREFIX_ROLES, prefix, PREFIX_DEFAULT)


def suffix_role(suffix: Column) -> Column:
    return _role(SUFFIX_ROLES, suffix, SUFFIX_DEFAULT)


def camel_prefix_role(prefix: Column) -> Column:
    return _role(CAMEL_ROLES, prefix, PREFIX_DEFAULT)


def concept_match(subtoken: Column, canonical: Column) -> Column:
    """Rank of a match of a subtoken with a concept: 0 exact, 1 one begins with the other and both have 4 bytes; else null."""
    long = (F.octet_length(subtoken) >= 4) & (F.octet_length(canonical) >= 4)
    return F.when(subtoken == canonical, F.lit(0)).when(long & (F.startswith(subtoken, canonical) | F.startswith(canonical, subtoken)), F.lit(1))


def last_part(x: Column) -> Column:
    """What follows the last dot: the base's or callee's own name."""
    return F.substring_index(x, ".", -1)


def scope_root(x: Column) -> Column:
    return F.substring_index(x, ".", 1)


def split_top_level(text: str) -> list[str]:
    """Cut at commas outside brackets."""
    depth, out = 0, [""]
    for c in text:
        depth += (c in "[(") - (c in "])")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def normalize_annotation(text: str) -> str:
    """Optional[X] is X, Union[...] its first part other than None, both at any depth."""
    t = text.strip()
    for head in ("Optional[", "typing.Optional["):
        if t.startswith(head) and t.endswith("]"):
            return normalize_annotation(t[len(head) : -1])
    for head in ("Union[", "typing.Union["):
        if t.startswith(head) and t.endswith("]"):
            parts = [p for p in split_top_level(t[len(head) : -1]) if p != "None"]
            return normalize_annotation(parts[0]) if parts else "None"
    return t


@F.pandas_udf(StringType())
def normalize_type_annotation(texts: pd.Series) -> pd.Series:
    """normalize_annotation over a column; recursion has no native form."""
    return texts.map(normalize_annotation, na_action="ignore")


def common_directory(paths: Column) -> Column:
    """The longest common directory of an array of paths; of one path its directory."""
    low, high = F.split(F.array_min(paths), "/"), F.split(F.array_max(paths), "/")
    # what the least and the greatest path share by parts, all paths between share
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(low), F.size(high)) - 1, F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct(
            F.when(s["on"] & (F.get(low, i - 1) == F.get(high, i - 1)) & (i < F.size(low)) & (i < F.size(high)), i).otherwise(s["n"]).alias("n"),
            (s["on"] & (F.get(low, i - 1) == F.get(high, i - 1)) & (i < F.size(low)) & (i < F.size(high))).alias("on"),
        ),
    )["n"]
    return F.array_join(F.slice(low, 1, n), "/")


def format_params(params: Column) -> Column:
    """``name: Type`` or ``name`` for each parameter."""
    return F.transform(params, lambda p: F.concat_ws(": ", p["name"], p["type_annotation"]))


def concept_text(canonical: Column, subtokens: Column, identifiers: Column, doc_words: Column) -> Column:
    """What is embedded for a concept: its name, subtokens, at most five identifiers, at most eight words of documentation."""
    words = F.filter(F.transform(doc_words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda w: F.length(w) > 2)
    head = F.array_distinct(F.concat(F.array(canonical), subtokens, F.slice(identifiers, 1, 5)))
    return F.array_join(F.array_distinct(F.concat(head, F.slice(F.array_except(words, head), 1, 8))), " ")


def token_estimate(text: Column) -> Column:
    return (F.octet_length(text) / 4).cast("long")


def dedent(text: str) -> str:
    """Without the white space that all lines but blank ones begin with."""
    lines = text.split("\n")
    n = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(x[n:] if x.strip() else x.strip() for x in lines) if n else text


def strip_docstring_quotes(text: str) -> str:
    t = text.strip()
    i = 0
    while i < len(t) and t[i] in "rRbBuUfF":
        i += 1
    body = t[i:]
    for q in ('"""', "'''", '"', "'"):
        if body.startswith(q) and body.endswith(q) and len(body) >= 2 * len(q):
            return body[len(q) : -len(q)].strip()
    return t


def strip_block_comment(text: str) -> str:
    """A ``/** ... */`` comment without its frame and the stars of its lines."""
    t = text.strip().removeprefix("/**").removeprefix("/*").removesuffix("*/")
    return "\n".join(x for x in (line.strip().removeprefix("*").strip() for line in t.split("\n")) if x)


def strip_line_doc(text: str) -> str:
    """Lines of ``///`` or ``//!`` without their marks; block comments as strip_block_comment()."""
    if text.lstrip().startswith("/*"):
        return strip_block_comment(text)
    return "\n".join(line.strip().removeprefix("///").removeprefix("//!").strip() for line in text.split("\n"))


def split_path(path: str) -> tuple[str, str]:
    """``a::b::C`` as (``a::b``, ``C``)."""
    head, _, tail = path.rpartition("::")
    return head, tail
