"""Inflected forms of regular words, as a table of (form, lemma) pairs.

Built from paradigms: the endings of an inflection class with the ending of
its lemma, and some stems that follow it. The table is a training set for
:mod:`quarry.operators.lemmas`; a user with a dictionary passes that instead.
"""

from __future__ import annotations

# --- fixed values: language, lemma's ending, endings, stems -------------------
PARADIGMS = (
    ("ru", "", "- а у ом е ы ов ам ами ах",
     "завод закон город журнал доклад народ поезд экран факт проект билет театр"),
    ("ru", "а", "а ы е у ой ам ами ах", "газет работ комнат школ машин картин минут ракет планет"),
    ("ru", "ый", "ый ого ому ым ом ая ой ую ое ые ых ыми",
     "нов красн важн главн активн добр стар сильн умн"),
    ("ru", "ать", "ать аю аешь ает аем аете ают ал ала али", "чит дел дум обещ реш отвеч помог"),
    ("en", "", "- s ed ing", "walk talk jump report open help follow count print learn load"),
    ("en", "e", "e es ed ing", "mov chang creat not clos us declar stor"),
    ("en", "y", "y ies", "cit part countr stor famil polic beaut"),
    ("de", "en", "en e st t te ten", "spiel mach sag frag lern hör glaub kauf"),
    ("de", "ung", "ung ungen", "zeit ordn hoff wohn mein lös heiz"),
    ("fr", "er", "er e es ons ez ent é ée és", "parl aim donn port march trouv chant"),
    ("es", "ar", "ar o as a amos an ó aron ado", "habl trabaj mir cant compr lleg pas"),
    ("es", "ción", "ción ciones", "na can esta direc solu informa aten"),
)
# --- end of fixed values ------------------------------------------------------


def pairs(fold: int | None = None, held_out: bool = False, folds: int = 4) -> list[tuple[str, str]]:
    """Distinct (form, lemma) pairs, sorted.

    With ``fold``, those of the stems outside that fold, or with ``held_out``
    those within it; stems are dealt to the folds in turn.
    """
    out = set()
    for _, lemma_ending, endings, stems in PARADIGMS:
        for i, stem in enumerate(stems.split()):
            if fold is None or (i % folds == fold) == held_out:
                out.update((stem + e.strip("-"), stem + lemma_ending) for e in endings.split())
    return sorted(out)
