"""What a language says to the corpus operators: a frozen set of literals, and hooks that are column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import paradigms
from glosswork.functions.glosses import ENGLISH_ENDINGS, Ending


def _same(x: Column) -> Column:
    return x


@dataclass(frozen=True)
class LanguageSpec:
    code: str
    #: Pattern of a word, marks that end a sentence, and whether words are parted by blanks.
    word: str = r"(\p{L}+)"
    ends: str = "[.!?\n]"
    spaced: bool = True
    #: Levels with their capacities, the last open; ambient ranks; peripheral shares.
    bands: tuple[tuple[str, int], ...] = (("A1", 600), ("A2", 700), ("B1", 700))
    ambient: int = 100
    shares: dict[str, float] = field(default_factory=lambda: {"A1": 0.10, "A2": 0.25, "B1": 0.40})
    #: Articles that a citation form may carry, and patterns of sentences that never ship.
    articles: tuple[str, ...] = ()
    bad: str = r"[#*$%&|<>]"
    lengths: tuple[int, int] = (3, 14)
    #: Hooks: the key of a typed or counted form, and the cleaning of a sentence.
    fold: Callable[[Column], Column] = F.lower
    clean: Callable[[Column], Column] = _same
    #: Rows of the paradigms by which citation forms are inflected.
    paradigm: tuple[paradigms.Row, ...] = ()
    #: Endings that a form may have, with what the base has in their place.
    endings: tuple[Ending, ...] = ()

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.word), 1)

    def sentences(self, text: Column) -> Column:
        parts = F.transform(F.split(text, self.ends), lambda s: self.clean(F.trim(s)))
        return F.filter(parts, lambda s: s != "")

    def bare(self, form: Column) -> Column:
        """A citation form without its article."""
        if not self.articles:
            return form
        return F.regexp_replace(form, rf"^(?:(?:{'|'.join(self.articles)})\s+)", "")

    def forms(self, words: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
        """(lang, lemma, pos, slot, form) of this language's words (lang, lemma, pos)."""
        return paradigms.forms(words, {self.code: self.paradigm}, irregular)

    def level(self, rank: Column) -> Column:
        out, reach = F.lit(self.bands[-1][0]), sum(n for _, n in self.bands[:-1])
        for name, n in reversed(self.bands[:-1]):
            out, reach = F.when(rank <= reach, name).otherwise(out), reach - n
        return out


LANGUAGES = {
    s.code: s
    for s in (
        LanguageSpec("en", articles=("the", "a", "an"), paradigm=paradigms.ENGLISH, endings=ENGLISH_ENDINGS),
        LanguageSpec("fr", articles=("le", "la", "les", "un", "une", "des"), paradigm=paradigms.FRENCH),
        LanguageSpec("de", articles=("der", "die", "das", "ein", "eine"), paradigm=paradigms.GERMAN),
        LanguageSpec("es", articles=("el", "la", "los", "las", "un", "una"), paradigm=paradigms.SPANISH),
    )
}
