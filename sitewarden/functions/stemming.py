"""Snowball stemmers for Russian and English as column expressions, and the rule that picks one for a word.

Each step takes the longest ending of its class (the leftmost match of an alternation at the end of the text) and then tests
its condition; a shorter ending is not tried. Endings count only within a region: RV for Russian (after the first vowel), R1 and R2 for
both (after the first consonant that follows a vowel, once and twice). The expressions are meant for distinct words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithms: vowels, endings and exceptions.
RU_VOWELS = "аеиоуыэюя"
RU_GERUND_AFTER_A = "в вши вшись"
RU_GERUND = "ив ивши ившись ыв ывши ывшись"
RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
RU_PARTICIPLE_AFTER_A = "ем нн вш ющ щ"
RU_PARTICIPLE = "ивш ывш ующ"
RU_REFLEXIVE = "ся сь"
RU_VERB_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
RU_VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
RU_SUPERLATIVE = "ейш ейше"
RU_DERIVATIONAL = "ост ость"
EN_VOWELS = "aeiouy"
EN_WHOLE = (
    "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl "
    "sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
)
EN_AFTER_1A = "inning outing canning herring earring proceed exceed succeed"
EN_R1_PREFIX = "gener commun arsen"
EN_DOUBLES = "bb dd ff gg mm nn pp rr tt"
EN_STEP_2 = (
    "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al "
    "fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:"
)
EN_STEP_3 = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"
EN_STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _ending(text: Column, endings: Iterable[str]) -> Column:
    """The longest of the endings the text has, or the empty string."""
    return F.regexp_extract(text, f"({'|'.join(endings)})$", 1)


def _without(text: Column, ending: Column) -> Column:
    return F.left(text, F.length(text) - F.length(ending))


# --- Russian ---------------------------------------------------------------------------------------------------------


def _drop(rv: Column, plain: str, after_a: str = "") -> Column:
    """``rv`` without the longest ending; null if it has none, or one that must follow а or я and does not."""
    def cut(ending: Column) -> Column:
        rest = _without(rv, ending)
        fits = (ending != "") & (ending.isin(plain.split()) | rest.rlike("[ая]$"))
        return F.when(fits, rest)

    return let(_ending(rv, plain.split() + after_a.split()), cut)


def _inflection(rv: Column) -> Column:
    def other(r: Column) -> Column:
        adjective = let(_drop(r, RU_ADJECTIVE), lambda a: F.coalesce(_drop(a, RU_PARTICIPLE, RU_PARTICIPLE_AFTER_A), a))
        return F.coalesce(adjective, _drop(r, RU_VERB, RU_VERB_AFTER_A), _drop(r, RU_NOUN), r)

    reflexive = F.regexp_replace(rv, f"({'|'.join(RU_REFLEXIVE.split())})$", "")
    return F.coalesce(_drop(rv, RU_GERUND, RU_GERUND_AFTER_A), let(reflexive, other))


def stem_russian(word: Column) -> Column:
    """The stem of a lower-cased word; words without a Russian vowel stay as they are."""
    v, c = f"[{RU_VOWELS}]", f"[^{RU_VOWELS}]"

    def of(w: Column) -> Column:
        head = F.regexp_extract(w, f"^{c}*{v}", 0)
        r2 = F.length(F.regexp_extract(w, f"^{c}*{v}+{c}+{v}+{c}", 0))
        return let(F.struct(F.when(head == "", w).otherwise(head).alias("head"), F.when(r2 == 0, F.length(w)).otherwise(r2).alias("r2")),
                   lambda s: F.concat(s["head"], tail(F.substring(w, F.length(s["head"]) + 1, F.length(w)), F.length(s["head"]), s["r2"])))

    def tail(rv: Column, head: Column, r2: Column) -> Column:
        def derivational(r: Column) -> Column:
            return let(_ending(r, RU_DERIVATIONAL.split()), lambda e: F.when(
                (e != "") & (head + F.length(r) - F.length(e) >= r2), _without(r, e)).otherwise(r))

        def tidy(r: Column) -> Column:
            superlative = _ending(r, RU_SUPERLATIVE.split())
            return let(superlative, lambda e: F.when(e != "", F.regexp_replace(_without(r, e), "нн$", "н")).otherwise(
                F.regexp_replace(r, "(?<=н)н$|ь$", "")))

        return let(let(F.regexp_replace(_inflection(rv), "и$", ""), derivational), tidy)

    return let(F.translate(word, "ё", "е"), of)


# --- English ---------------------------------------------------------------------------------------------------------

_V = f"[{EN_VOWELS}]"
_SHORT_END = f"([^{EN_VOWELS}]{_V}[^{EN_VOWELS}wxY]|^{_V}[^{EN_VOWELS}])$"


def _pairs(rules: str) -> dict[str, str]:
    return dict(r.split(":") for r in rules.split())


def _replaced(word: Column, rules: dict[str, str], fits: Callable[[Column, Column], Column]) -> Column:
    """The longest ending replaced by its rule if ``fits(rest, ending)``."""
    table = F.create_map(*[F.lit(x) for r in rules.items() for x in r])
    return let(_ending(word, rules), lambda e: F.when(
        (e != "") & fits(_without(word, e), e), F.concat(_without(word, e), F.element_at(table, e))).otherwise(word))


def _step_1a(w: Column) -> Column:
    vowel_before = w.rlike(f"{_V}.+s$")
    return let(_ending(w, ["sses", "ied", "ies", "us", "ss", "s"]), lambda e: (
        F.when(e == "sses", F.left(w, F.length(w) - 2))
        .when(e.isin("ied", "ies"), F.left(w, F.length(w) - F.when(F.length(w) > 4, F.lit(2)).otherwise(F.lit(1))))
        .when((e == "s") & vowel_before, F.left(w, F.length(w) - 1))
        .otherwise(w)))


def _step_1b(w: Column, p1: Column) -> Column:
    def mended(r: Column) -> Column:
        short = r.rlike(_SHORT_END) & (F.length(r) <= p1)
        return (
            F.when(r.rlike("(at|bl|iz)$"), F.concat(r, F.lit("e")))
            .when(r.rlike(f"({'|'.join(EN_DOUBLES.split())})$"), F.left(r, F.length(r) - 1))
            .when(short, F.concat(r, F.lit("e")))
            .otherwise(r))

    def by(e: Column) -> Column:
        rest = _without(w, e)
        return (
            F.when(e.isin("eed", "eedly"), F.when(F.length(rest) >= p1, F.concat(rest, F.lit("ee"))).otherwise(w))
            .when((e != "") & rest.rlike(_V), let(rest, mended))
            .otherwise(w))

    return let(_ending(w, ["eedly", "eed", "ingly", "edly", "ing", "ed"]), by)


def stem_english(word: Column) -> Column:
    """The stem of a lower-cased word of ASCII letters without apostrophes."""
    whole = F.element_at(F.create_map(*[F.lit(x) for r in _pairs(EN_WHOLE).items() for x in r]), word)
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({_V})y", "$1Y")

    def regions(w: Column) -> Column:
        def after(start: Column) -> Column:
            found = F.length(F.regexp_extract(F.substring(w, start + 1, F.length(w)), f"^.*?{_V}[^{EN_VOWELS}]", 0))
            return F.when(found == 0, F.length(w)).otherwise(start + found)

        prefix = F.length(F.regexp_extract(w, f"^({'|'.join(EN_R1_PREFIX.split())})", 0))
        p1 = F.when(prefix > 0, prefix).otherwise(after(F.lit(0)))
        return let(p1, lambda p: let(after(p), lambda q: steps(w, p, q)))

    def steps(w: Column, p1: Column, p2: Column) -> Column:
        in_r1 = lambda rest: F.length(rest) >= p1
        in_r2 = lambda rest: F.length(rest) >= p2

        def later(v: Column) -> Column:
            one = let(_step_1b(v, p1), lambda x: F.when(
                x.rlike(f"^.+[^{EN_VOWELS}][yY]$"), F.concat(F.left(x, F.length(x) - 1), F.lit("i"))).otherwise(x))
            two = let(one, lambda x: _replaced(x, _pairs(EN_STEP_2), lambda rest, e: in_r1(rest) & F.when(
                e == "li", rest.rlike("[cdeghkmnrt]$")).when(e == "ogi", rest.endswith("l")).otherwise(F.lit(True))))
            three = let(two, lambda x: _replaced(x, _pairs(EN_STEP_3), lambda rest, e: F.when(e == "ative", in_r2(rest)).otherwise(in_r1(rest))))
            four = let(three, lambda x: _replaced(x, dict.fromkeys(EN_STEP_4.split(), ""), lambda rest, e: in_r2(rest) & (
                (e != "ion") | rest.rlike("[st]$"))))

            def five(x: Column) -> Column:
                rest = F.left(x, F.length(x) - 1)
                return (
                    F.when(x.endswith("e") & (in_r2(rest) | (in_r1(rest) & ~rest.rlike(_SHORT_END))), rest)
                    .when(x.endswith("ll") & in_r2(rest), rest)
                    .otherwise(x))

            return let(four, five)

        return let(_step_1a(w), lambda a: F.when(a.isin(EN_AFTER_1A.split()), a).otherwise(later(a)))

    stemmed = F.translate(let(marked, regions), "Y", "y")
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(whole, stemmed))


# --- the search configuration ------------------------------------------------------------------------------------------

#: No stemming and no stop words; or English rules for words of ASCII letters and Russian ones for other words.
SIMPLE, RUSSIAN = "simple", "russian"


@lru_cache(maxsize=4)
def stop_words(language: str) -> tuple[str, ...]:
    """Spark's list of a language; needs an active session."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def search_term(word: Column, config: str = RUSSIAN, stop: Sequence[str] | None = None) -> Column:
    """What a lower-cased word is searched and found by: its stem, or null for a stop word. Words with a digit stay as they are.

    ``stop`` replaces the stop words of the configuration.
    """
    if config not in (SIMPLE, RUSSIAN):
        raise ValueError(f"unknown search configuration {config!r}")
    known = (lambda language: stop_words(language)) if stop is None and config == RUSSIAN else (lambda language: tuple(stop or ()))
    kept = lambda language: ~word.isin(*known(language)) if known(language) else F.lit(True)
    if config == SIMPLE:
        return F.when(kept(""), word)
    return (
        F.when(word.rlike(r"\p{N}"), F.when(kept("english"), word))
        .when(word.rlike("^[a-z]+$"), F.when(kept("english"), stem_english(word)))
        .when(kept("russian"), stem_russian(word))
    )
