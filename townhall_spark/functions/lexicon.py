"""Topic lexicon: term hits, hazard tag and the category decision as Columns.

Matching is substring matching on lower-cased text, with no word boundaries;
overlapping terms all count. A long list is one pattern, and a text is read once for
all of its terms; a short one is an array literal searched with higher-order functions.
Swapping the lexicon retargets everything.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from townhall_spark.functions.literals import quoted, text_array
from townhall_spark.functions.text import let, sentences
from townhall_spark.schemas import ADAPTATION_CATEGORIES

CLIMATE_LEXICON = Path(__file__).resolve().parents[1] / "config" / "lexicon_climate.yaml"

# Version stamp, stored length of an excerpt, confidence steps.
LEXICON_VERSION = "lexicon:climate-v1"
ACTION_TEXT_CHARS = 500
CONFIDENCE_SEVERAL_STRONG = 0.9
CONFIDENCE_ONE_STRONG = 0.75
CONFIDENCE_GENERIC = 0.6
CONFIDENCE_NOTHING = 0.5
CONFIDENCE_WEAK_ONLY = 0.45


@dataclass(frozen=True)
class Lexicon:
    """Term lists of one topic; ``hazards`` is ordered, the first match wins."""

    adaptation_strong: tuple[str, ...]
    mitigation_strong: tuple[str, ...]
    climate_generic: tuple[str, ...]
    weak_context: tuple[str, ...]
    procedural: tuple[str, ...]
    hazards: tuple[tuple[str, tuple[str, ...]], ...]
    topic: str = ""

    @classmethod
    def from_mapping(cls, data: Mapping[str, Any]) -> Lexicon:
        def terms(name: str) -> tuple[str, ...]:
            return tuple(data[name])

        return cls(
            adaptation_strong=terms("adaptation_strong"),
            mitigation_strong=terms("mitigation_strong"),
            climate_generic=terms("climate_generic"),
            weak_context=terms("weak_context"),
            procedural=terms("procedural"),
            hazards=tuple((name, tuple(words)) for name, words in data["hazards"].items()),
            topic=str(data.get("topic", "")),
        )

    @property
    def climate_terms(self) -> tuple[str, ...]:
        """Terms without any of which a text is always ``unrelated``."""
        return self.adaptation_strong + self.mitigation_strong + self.climate_generic


@lru_cache(maxsize=8)
def load_lexicon(path: str = str(CLIMATE_LEXICON)) -> Lexicon:
    """Lexicon of a YAML file, read once per driver."""
    import yaml

    return Lexicon.from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


# Lists of more terms are searched for in one pass, by a pattern of all of them; for fewer
# a search for each is quicker. Both give the same hits.
SINGLE_PASS_TERMS = 40


def term_pattern(words: Sequence[str]) -> str:
    """A pattern of the terms as a tree of their common beginnings.

    At any place of a text it matches the longest term that begins there, and reads no
    character twice to find it.
    """
    tree: dict[str, dict] = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(char: str) -> str:
        return char if char.isalnum() and char.isascii() else rf"\x{{{ord(char):x}}}"

    def rest(node: dict) -> str:
        parts = [written(c) + rest(node[c]) for c in sorted(node) if c]
        if not parts:
            return ""
        # Of several ends the longest counts, so going on comes first.
        joined = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return joined + ("?" if "" in node else "")

    first = "".join(written(c) for c in sorted(tree) if c)
    return f"(?=[{first}]){rest(tree)}"


def _in_one_pass(words: Sequence[str]) -> bool:
    return len(words) > SINGLE_PASS_TERMS and "" not in words


def _found(low: Column, words: Sequence[str]) -> Column:
    """Array of the different terms that occur, in one pass over the text.

    A match is the longest term at its place; shorter ones that it begins with occur,
    too. Matches take no room, so terms that overlap are all found.
    """
    matches = F.array_distinct(F.regexp_extract_all(
        low, F.lit(f"(?=({term_pattern(words)}))"), F.lit(1)))
    known = set(words)
    begun = {w: [w[:n] for n in range(1, len(w)) if w[:n] in known] for w in sorted(known)}
    begun = {w: short for w, short in begun.items() if short}
    if not begun:
        return matches
    entries = ", ".join(f"{quoted(w)}, array({', '.join(map(quoted, short))})"
                        for w, short in begun.items())
    shorter = F.expr(f"map({entries})")
    return let(matches, lambda m: F.array_distinct(F.concat(m, F.flatten(F.filter(
        F.transform(m, lambda w: F.element_at(shorter, w)), lambda x: x.isNotNull())))))


def _hits(low: Column, words: Sequence[str]) -> Column:
    # ``low`` stands inside a lambda: it must be bound, or it is recomputed per term.
    if not _in_one_pass(words):
        return F.filter(text_array(words), lambda term: F.contains(low, term))
    return let(_found(low, words), lambda found: F.when(
        F.size(found) > 0, F.filter(text_array(words), lambda t: F.array_contains(found, t)))
        .otherwise(text_array([])))


def _any_hit(low: Column, words: Sequence[str]) -> Column:
    if not _in_one_pass(words):
        return F.exists(text_array(words), lambda term: F.contains(low, term))
    return F.rlike(low, F.lit(term_pattern(words)))


def _hazard(low: Column, lexicon: Lexicon) -> Column:
    if not lexicon.hazards:
        return F.lit("other")
    every = [w for _, words in lexicon.hazards for w in words]
    if not _in_one_pass(every):
        return _first_hazard(lexicon, lambda words: _any_hit(low, words))
    return let(_found(low, every), lambda found: _first_hazard(
        lexicon, lambda words: F.arrays_overlap(found, text_array(words))))


def _first_hazard(lexicon: Lexicon, occurs: Callable[[Sequence[str]], Column]) -> Column:
    (first, words), *rest = lexicon.hazards
    tag = F.when(occurs(words), first)
    for name, words in rest:
        tag = tag.when(occurs(words), name)
    return tag.otherwise("other")


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def term_hits(text: Column, words: Sequence[str]) -> Column:
    """Array of the terms that occur in the text in any case."""
    return let(_lowered(text), lambda low: _hits(low, words))


def hazard_tag(text: Column, lexicon: Lexicon) -> Column:
    """First hazard, in lexicon order, one of whose terms occurs, else ``other``."""
    return let(_lowered(text), lambda low: _hazard(low, lexicon))


def _counts(low: Column, lexicon: Lexicon) -> Column:
    return F.struct(
        low.alias("low"),
        F.size(_hits(low, lexicon.adaptation_strong)).alias("adapt"),
        F.size(_hits(low, lexicon.mitigation_strong)).alias("mitig"),
        _any_hit(low, lexicon.climate_generic).alias("generic"),
        _any_hit(low, lexicon.weak_context).alias("weak"),
        _any_hit(low, lexicon.procedural).alias("procedural"),
    )


def _decide(n: Column, lexicon: Lexicon) -> Column:
    """Category, hazard and confidence from the hit counts of one text."""
    strong = n.adapt + n.mitig
    climate = (strong > 0) | n.generic
    category = (
        F.when(~climate, "unrelated")
        .when((n.adapt > 0) & (n.mitig > 0), "both")
        .when(n.adapt > 0, "adaptation")
        .when(n.mitig > 0, "mitigation")
        .when(n.weak, "both")
        .otherwise("unrelated")
    )
    confidence = (
        F.when(~climate & (n.procedural | ~n.weak), F.lit(CONFIDENCE_NOTHING))
        .when(~climate, F.lit(CONFIDENCE_WEAK_ONLY))
        .when(strong >= 2, F.lit(CONFIDENCE_SEVERAL_STRONG))
        .when(strong == 1, F.lit(CONFIDENCE_ONE_STRONG))
        .otherwise(F.lit(CONFIDENCE_GENERIC))
    )
    return let(category, lambda c: F.struct(
        c.alias("category"),
        F.when(c.isin(*ADAPTATION_CATEGORIES), _hazard(n.low, lexicon))
        .otherwise("none").alias("hazard"),
        confidence.alias("confidence"),
    ))


def classify_lowered(low: Column, lexicon: Lexicon) -> Column:
    """:func:`classify` for text that is already lower-cased."""
    return let(_counts(low, lexicon), lambda n: _decide(n, lexicon))


def classify(text: Column, lexicon: Lexicon) -> Column:
    """``struct<category, hazard, confidence>`` of any text; null counts as empty."""
    return let(_lowered(text), lambda low: classify_lowered(low, lexicon))


def _labelled(text: Column, terms: Column, lexicon: Lexicon) -> Column:
    lowered = F.transform(sentences(text), lambda s, i: F.struct(
        i.alias("pos"), s.alias("text"), F.lower(s).alias("low")))
    candidates = F.filter(lowered, lambda x: F.exists(
        terms, lambda term: F.contains(x.low, term)))
    labelled = F.transform(candidates, lambda x: F.struct(
        x.pos.alias("pos"), x.text.alias("text"),
        classify_lowered(x.low, lexicon).alias("label")))
    return F.filter(labelled, lambda x: x.label.category != "unrelated")


def labelled_sentences(text: Column, lexicon: Lexicon) -> Column:
    """Array of ``struct<pos, text, label>`` of the sentences that are actions.

    A sentence without a climate term can only be ``unrelated``. So the climate
    terms that occur anywhere in the text are found first: a text with none of
    them is not even split, and sentences are searched for those few only
    before the full decision is made.
    """
    return let(term_hits(text, lexicon.climate_terms), lambda terms: F.when(
        F.size(terms) > 0, _labelled(text, terms, lexicon)))
