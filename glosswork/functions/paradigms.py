"""Inflected forms from paradigm tables, compiled to column expressions.

A paradigm is a table of rows (part of speech, slot, condition, letters cut,
endings). For a word, the first row of a slot whose condition, a pattern on
the citation form, holds gives the slot's forms: the word without the letters
cut, with each ending. An ending may put a prefix before (`ge+` in `ge+t`) and
double the last letter that is left (`=` in `=ing`); `-` adds nothing. Forms of
irregular words stand in a table of their own and take the place of a slot.

`forms` explodes a table of words to one row a form, so that text is linked by a
join of surfaces with forms; nothing is analysed by row-at-a-time code.
Defined results: null or empty words have no forms; a form made twice in a
slot counts once; forms equal to the word itself are kept, so that each slot
is whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMS = "array<struct<pos:string,slot:string,form:string>>"


@dataclass(frozen=True)
class Row:
    pos: str
    slot: str
    when: str
    cut: int
    endings: tuple[str, ...]


def table(text: str) -> tuple[Row, ...]:
    """Rows from lines `pos slot | condition | cut | endings`; a line whose pos and slot are a ditto sign takes those of the line before."""
    out: list[Row] = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, when, cut, endings = (x.strip() for x in line.split("|"))
        pos, slot = (out[-1].pos, out[-1].slot) if name == '"' else name.split()
        out.append(Row(pos, slot, "" if when == "*" else when.replace("/", "|"), int(cut), tuple(endings.split())))
    return tuple(out)


def _form(word: Column, cut: int, ending: str) -> Column:
    before, _, after = ending.rpartition("+")
    stem = F.substring(word, F.lit(1), F.greatest(F.length(word) - cut, F.lit(0))) if cut else word
    parts = [F.lit(before)] if before else []
    parts.append(stem)
    if after.startswith("="):
        parts.append(F.right(stem, F.lit(1)))
        after = after[1:]
    if after and after != "-":
        parts.append(F.lit(after))
    return F.concat(*parts) if len(parts) > 1 else stem


def slots(word: Column, paradigm: tuple[Row, ...], pos: Column | None = None) -> Column:
    """array<struct<pos, slot, form>> of a word; of one part of speech where pos is not null."""
    none, groups = F.array().cast(FORMS), {}
    for r in paradigm:
        groups.setdefault((r.pos, r.slot), []).append(r)
    named = lambda part, slot: lambda x: F.struct(F.lit(part).alias("pos"), F.lit(slot).alias("slot"), x.alias("form"))
    made = []
    for (part, slot), rows in groups.items():
        out = none
        for r in reversed(rows):
            forms = F.transform(F.array_distinct(F.array(*[_form(word, r.cut, e) for e in r.endings])), named(part, slot))
            # A word is longer than what is cut from it, so no form is a bare ending.
            holds = F.length(word) > r.cut
            out = F.when(holds & word.rlike(r.when) if r.when else holds, forms).otherwise(out)
        made.append(out if pos is None else F.when(F.coalesce(pos == part, F.lit(True)), out).otherwise(none))
    return F.when(F.length(word) > 0, F.concat(*made)).otherwise(none) if made else none


def forms(words: DataFrame, paradigms: dict[str, tuple[Row, ...]], irregular: DataFrame | None = None) -> DataFrame:
    """(lang, lemma, pos, slot, form): all forms of words (lang, lemma, pos), each by its language's paradigm; pos null takes every part of speech.

    irregular: (lang, lemma, pos, slot, form); where it has a slot of a word, the
    paradigm's forms of that slot do not count. One pass over the words, and
    none over text.
    """
    x = words.select("lang", "lemma", "pos").distinct()
    made = F.array().cast(FORMS)
    for lang, rows in paradigms.items():
        made = F.when(F.col("lang") == lang, slots(F.col("lemma"), rows, F.col("pos"))).otherwise(made)
    out = x.select("lang", "lemma", F.explode(made).alias("f")).select("lang", "lemma", "f.pos", "f.slot", "f.form")
    if irregular is not None:
        own = ["lang", "lemma", "pos", "slot"]
        known = irregular.join(x.withColumnRenamed("pos", "p"), ["lang", "lemma"]).filter("p IS NULL OR p = pos").select(*own, "form")
        out = out.join(known.select(*own), own, "left_anti").unionByName(known)
    return out.distinct()


def edges(made: DataFrame) -> DataFrame:
    """(lang, surface, lemma): what a surface may be a form of, without the words themselves."""
    return made.filter("form <> lemma").select("lang", F.col("form").alias("surface"), "lemma").distinct()


# Paradigms of regular words. They are rules, not lists: every word that meets a condition gets the forms.
ENGLISH = table("""
    noun plural | (s/x/z/ch/sh)$ | 0 | es
    " | [^aeiou]y$ | 1 | ies
    " | [^aeiou]o$ | 0 | es
    " | * | 0 | s
    verb third | (s/x/z/ch/sh/[^aeiou]o)$ | 0 | es
    " | [^aeiou]y$ | 1 | ies
    " | * | 0 | s
    verb gerund | ie$ | 2 | ying
    " | (ee/oe/ye)$ | 0 | ing
    " | e$ | 1 | ing
    " | ^[^aeiou]*[aeiou][^aeiouwxy]$ | 0 | =ing
    " | * | 0 | ing
    verb past | e$ | 0 | d
    " | [^aeiou]y$ | 1 | ied
    " | ^[^aeiou]*[aeiou][^aeiouwxy]$ | 0 | =ed
    " | * | 0 | ed
    adj degrees | e$ | 0 | r st
    " | [^aeiou]y$ | 1 | ier iest
    " | ^[^aeiou]*[aeiou][^aeiouwxy]$ | 0 | =er =est
    " | ^.{2,6}$ | 0 | er est
    adj adverb | [^aeiou]y$ | 1 | ily
    " | [^aeiou]le$ | 1 | y
    " | ic$ | 0 | ally
    " | * | 0 | ly
""")
FRENCH = table("""
    noun plural | (s/x/z)$ | 0 | -
    " | (au/eu)$ | 0 | x
    " | al$ | 2 | aux
    " | * | 0 | s
    adj feminine | e$ | 0 | -
    " | eux$ | 1 | se
    " | f$ | 1 | ve
    " | er$ | 2 | ère
    " | (en/on/el/eil)$ | 0 | =e
    " | * | 0 | e
    adj plural | (s/x)$ | 0 | -
    " | al$ | 2 | aux
    " | * | 0 | s
    verb present | ger$ | 2 | e es eons ez ent
    " | cer$ | 3 | ce ces çons cez cent
    " | (oyer/uyer)$ | 3 | ie ies yons yez ient
    " | er$ | 2 | e es ons ez ent
    " | ir$ | 1 | s t ssons ssez ssent
    " | re$ | 2 | s - ons ez ent
    verb imperfect | ger$ | 2 | eais eait ions iez eaient
    " | cer$ | 3 | çais çait cions ciez çaient
    " | er$ | 2 | ais ait ions iez aient
    " | ir$ | 1 | ssais ssait ssions ssiez ssaient
    " | re$ | 2 | ais ait ions iez aient
    verb future | (er/ir)$ | 0 | ai as a ons ez ont
    " | re$ | 1 | ai as a ons ez ont
    verb conditional | (er/ir)$ | 0 | ais ait ions iez aient
    " | re$ | 1 | ais ait ions iez aient
    verb participle | er$ | 2 | é ée és ées
    " | ir$ | 1 | - e s es
    " | re$ | 2 | u ue us ues
    verb gerund | ger$ | 2 | eant
    " | cer$ | 3 | çant
    " | er$ | 2 | ant
    " | ir$ | 1 | ssant
    " | re$ | 2 | ant
""")
GERMAN = table("""
    noun plural | (ung/heit/keit/schaft/ion/tät)$ | 0 | en
    " | in$ | 0 | nen
    " | e$ | 0 | n
    " | (er/el/en/chen/lein)$ | 0 | - n
    " | [aiouy]$ | 0 | s
    " | * | 0 | e en er
    noun genitive | (ung/heit/keit/schaft/ion/tät/in/e)$ | 0 | -
    " | (er/el/en/chen/lein/[aiouy])$ | 0 | s
    " | (s/ß/x/z)$ | 0 | es
    " | * | 0 | s es
    adj endings | e$ | 0 | - n r s m
    " | el$ | 2 | le len ler les lem
    " | * | 0 | e en er es em
    adj comparative | e$ | 0 | r re ren rer res
    " | el$ | 2 | ler lere leren lerer leres
    " | * | 0 | er ere eren erer eres
    adj superlative | [tdsßxz]$ | 0 | este esten ester estes
    " | e$ | 0 | ste sten ster stes
    " | * | 0 | ste sten ster stes
    verb present | [td]en$ | 2 | e est et en
    " | (eln/ern)$ | 1 | e st t n
    " | (s/ß/x/z)en$ | 2 | e t en
    " | en$ | 2 | e st t en
    verb past | [td]en$ | 2 | ete etest eten etet
    " | (eln/ern)$ | 1 | te test ten tet
    " | en$ | 2 | te test ten tet
    verb participle | ieren$ | 2 | t
    " | ^(be/emp/ent/er/ge/miss/ver/zer).+[td]en$ | 2 | et
    " | ^(be/emp/ent/er/ge/miss/ver/zer).+en$ | 2 | t
    " | [td]en$ | 2 | ge+et
    " | (eln/ern)$ | 1 | ge+t
    " | en$ | 2 | ge+t
    verb zu | (en/eln/ern)$ | 0 | zu+-
    verb gerund | (en/eln/ern)$ | 0 | d de den der des
""")
SPANISH = table("""
    noun plural | z$ | 1 | ces
    " | ión$ | 2 | ones
    " | [aeiouáéó]$ | 0 | s
    " | [aeo]s$ | 0 | -
    " | * | 0 | es
    adj agreement | o$ | 1 | a os as
    " | or$ | 0 | a es as
    " | z$ | 1 | ces
    " | [ae]$ | 0 | s
    " | * | 0 | es
    verb present | ar$ | 2 | o as a amos áis an
    " | er$ | 2 | o es e emos éis en
    " | ir$ | 2 | o es e imos ís en
    verb past | car$ | 3 | qué caste có camos casteis caron
    " | gar$ | 2 | ué aste ó amos asteis aron
    " | zar$ | 3 | cé zaste zó zamos zasteis zaron
    " | ar$ | 2 | é aste ó amos asteis aron
    " | (er/ir)$ | 2 | í iste ió imos isteis ieron
    verb imperfect | ar$ | 2 | aba abas ábamos abais aban
    " | (er/ir)$ | 2 | ía ías íamos íais ían
    verb future | (ar/er/ir)$ | 0 | é ás á emos éis án
    verb conditional | (ar/er/ir)$ | 0 | ía ías íamos íais ían
    verb subjunctive | car$ | 3 | que ques quemos quéis quen
    " | gar$ | 2 | ue ues uemos uéis uen
    " | zar$ | 3 | ce ces cemos céis cen
    " | ar$ | 2 | e es emos éis en
    " | (er/ir)$ | 2 | a as amos áis an
    verb participle | ar$ | 2 | ado ada ados adas
    " | (er/ir)$ | 2 | ido ida idos idas
    verb gerund | ar$ | 2 | ando
    " | (er/ir)$ | 2 | iendo
    verb enclitic | (ar/er/ir)$ | 0 | se me te lo la los las le les nos
""")
# The endings of Hindi, Urdu and Swahili by which the text of those languages is linked; vowel signs and letters as they are written.
_HINDI_VOWELS = "[ािीुूृेैोौअआइईउऊएऐओऔ]"
HINDI = table(f"""
    verb stem | .ना$ | 2 | - ने नी ता ती ते तीं कर
    verb perfect | .{_HINDI_VOWELS}ना$ | 2 | या ई ए ईं
    " | .ना$ | 2 | ा ी े ीं
    verb finite | .{_HINDI_VOWELS}ना$ | 2 | ऊं ए एं ओ ऊंगा ऊंगी एगा एगी एंगे एंगी ओगे ओगी इए इएगा
    " | .ना$ | 2 | ूं े ें ो ूंगा ूंगी ेगा ेगी ेंगे ेंगी ोगे ोगी िए िएगा
""")
URDU = table("""
    verb stem | .نا$ | 2 | - نے نی تا تی تے تیں
    verb finite | .[او]نا$ | 2 | یا ئی ئے ئیں وں ئیے یے و
    " | .ینا$ | 2 | ا ے ں و یے
    " | .[^ے]نا$ | 2 | ا ی ے یں وں و یے ئیے ئے
    noun oblique | یا$ | 0 | ں
    " | [اہ]$ | 1 | ے وں
    " | ی$ | 0 | اں وں
    " | * | 0 | وں یں
    adj agreement | ..ا$ | 1 | ے ی
""")
SWAHILI = table("""
    adj classes | ^e | 0 | mw+- w+- my+- j+- m+- ch+- vy+- ny+- kw+- p+-
    " | ^[aou] | 0 | mw+- w+- my+- j+- ma+- ch+- vy+- ny+- kw+- p+-
    " | ^[bv] | 0 | m+- wa+- mi+- ji+- - ma+- ki+- vi+- ku+- pa+- mu+- u+- zi+- li+-
    " | ^[dgjz] | 0 | m+- wa+- mi+- ji+- - ma+- ki+- vi+- n+- ku+- pa+- mu+- u+- zi+- li+-
    " | ^[^aeioudgjzbvrlw] | 0 | m+- wa+- mi+- ji+- - ma+- ki+- vi+- ku+- pa+- mu+- u+- zi+- li+-
""")
PARADIGMS = {"en": ENGLISH, "fr": FRENCH, "de": GERMAN, "es": SPANISH, "hi": HINDI, "ur": URDU, "sw": SWAHILI}
#: Irregular forms as (language, word, part of speech, slot, forms); fixed values of the languages.
IRREGULAR = (
    ("en", "be", "verb", "third", "is are am"), ("en", "be", "verb", "past", "was were been"), ("en", "have", "verb", "third", "has"), ("en", "have", "verb", "past", "had"),
    ("en", "do", "verb", "past", "did done"), ("en", "go", "verb", "past", "went gone"), ("en", "see", "verb", "past", "saw seen"), ("en", "take", "verb", "past", "took taken"),
    ("en", "man", "noun", "plural", "men"), ("en", "woman", "noun", "plural", "women"), ("en", "child", "noun", "plural", "children"), ("en", "foot", "noun", "plural", "feet"),
    ("fr", "être", "verb", "present", "suis es est sommes êtes sont"), ("fr", "avoir", "verb", "present", "ai as a avons avez ont"), ("fr", "aller", "verb", "present", "vais vas va allons allez vont"), ("fr", "faire", "verb", "present", "fais fait faisons faites font"),
    ("de", "sein", "verb", "present", "bin bist ist sind seid"), ("de", "haben", "verb", "present", "habe hast hat haben habt"), ("de", "werden", "verb", "present", "werde wirst wird werden werdet"),
    ("es", "ser", "verb", "present", "soy eres es somos sois son"), ("es", "estar", "verb", "present", "estoy estás está estamos estáis están"), ("es", "ir", "verb", "present", "voy vas va vamos vais van"), ("es", "haber", "verb", "present", "he has ha hemos habéis han"),
    ("hi", "जाना", "verb", "perfect", "गया गई गए गईं"), ("hi", "करना", "verb", "perfect", "किया की किए कीं"), ("hi", "लेना", "verb", "perfect", "लिया ली लिए लीं"), ("hi", "देना", "verb", "perfect", "दिया दी दिए दीं"),
    ("hi", "होना", "verb", "perfect", "हुआ हुई हुए हुईं"), ("hi", "पीना", "verb", "perfect", "पिया पी पिए पीं"), ("hi", "जीना", "verb", "perfect", "जिया जी जिए जीं"),
)


def irregular(spark) -> DataFrame:
    """(lang, lemma, pos, slot, form) of IRREGULAR."""
    rows = [(lang, lemma, pos, slot, form) for lang, lemma, pos, slot, some in IRREGULAR for form in some.split()]
    return spark.createDataFrame(rows, "lang string, lemma string, pos string, slot string, form string")
