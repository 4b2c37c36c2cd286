"""The books that references name: abbreviation, chapters, display name, and the names a speaker or a file may use."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Abbreviation; chapters; display name; other names. Marks don't count when names are compared.
BOOKS = [
    tuple(part.strip() for part in line.split(";"))
    for line in """
Gen; 50; Genèse; gen, gn
Ex; 40; Exode; ex
Lév; 27; Lévitique; lév, lv
Nb; 36; Nombres; nbr, nb
Dt; 34; Deutéronome; deut, dt
Jos; 24; Josué; jos
Jg; 21; Juges; jug, jg
Rt; 4; Ruth; rut, rt
1 S; 31; 1 Samuel; 1sam, 1s, 1 s
2 S; 24; 2 Samuel; 2sam, 2s, 2 s
1 R; 22; 1 Rois; 1rois, 1r, 1 r
2 R; 25; 2 Rois; 2rois, 2r, 2 r
1 Ch; 29; 1 Chroniques; 1chron, 1ch, 1 ch
2 Ch; 36; 2 Chroniques; 2chron, 2ch, 2 ch
Esd; 10; Esdras; esd
Neh; 13; Néhémie; neh
Est; 10; Esther; est
Job; 42; Job; jb
Ps; 150; Psaumes; psaume, ps
Pr; 31; Proverbes; prov, pr
Ec; 12; Ecclésiaste; eccl, ec
Ct; 8; Cantique des cantiques; cantique, cant, ct
És; 66; Ésaïe; esai, es
Jér; 52; Jérémie; jer, jr
Lm; 5; Lamentations; lam, lm, lamentations de jérémie
Éz; 48; Ézéchiel; ez
Dn; 12; Daniel; dan, dn
Os; 14; Osée; ose
Jl; 3; Joël; joel
Am; 9; Amos; am
Abd; 1; Abdias; abd
Jon; 4; Jonas; jon
Mi; 7; Michée; micée, mi
Na; 3; Nahum; na
Hab; 3; Habacuc; hab
So; 3; Sophonie; soph
Ag; 2; Aggée; agee, ag
Za; 14; Zacharie; zach
Ml; 4; Malachie; mal
Mt; 28; Matthieu; mat, mt
Mc; 16; Marc; mar, mc
Lc; 24; Luc;
Jn; 21; Jean; jn
Ac; 28; Actes; act, ac, actes des apôtres
Rm; 16; Romains; rom, rm
1 Co; 16; 1 Corinthiens; 1cor, 1co, 1 co
2 Co; 13; 2 Corinthiens; 2cor, 2co, 2 co
Ga; 6; Galates; gal
Éph; 6; Éphésiens; eph
Ph; 4; Philippiens; phil
Col; 4; Colossiens; col
1 Th; 5; 1 Thessaloniciens; 1thes, 1th, 1 th
2 Th; 3; 2 Thessaloniciens; 2thes, 2th, 2 th
1 Tm; 6; 1 Timothée; 1tim, 1tm, 1 tm
2 Tm; 4; 2 Timothée; 2tim, 2tm, 2 tm
Tt; 3; Tite; tit
Phm; 1; Philémon; phm
He; 13; Hébreux; heb
Jc; 5; Jacques; jac
1 P; 5; 1 Pierre; 1pier, 1p, 1 p
2 P; 3; 2 Pierre; 2pier, 2p, 2 p
1 Jn; 5; 1 Jean; 1jn, 1 jn
2 Jn; 1; 2 Jean; 2jn, 2 jn
3 Jn; 1; 3 Jean; 3jn, 3 jn
Jude; 1; Jude; jud
Ap; 22; Apocalypse; apoc, ap, révélation, rev
""".strip().splitlines()
]

# Short names of editions with their long and short titles.
EDITIONS = [
    ("LSG", "Louis Segond 1910", "Segond 1910"),
    ("KJF", "King James Française", "King James fr."),
    ("NBS", "Nouvelle Bible Segond", "Nouvelle Segond"),
    ("SEM", "Bible du Semeur", "Semeur"),
    ("TOB", "Traduction œcuménique de la Bible", "TOB"),
    ("FC", "Bible en français courant", "Français courant"),
    ("DBY", "Bible Darby", "Darby"),
]


def plain(text: str) -> str:
    """Lower case without marks."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


@cache
def names() -> list[tuple[str, str]]:
    """(name without marks, abbreviation), the first of equal names, longest names first."""
    found: dict[str, str] = {}
    for abbr, _, display, others in BOOKS:
        for name in (display, *(x for x in map(str.strip, others.split(",")) if x)):
            found.setdefault(plain(name), abbr)
    return sorted(found.items(), key=lambda x: -len(x[0]))


@cache
def _prefixes() -> dict[str, str]:
    found: dict[str, str] = {}
    for name, abbr in names():
        for n in range(2, len(name)):
            found.setdefault(name[:n], abbr)
    return found | dict(names())


def resolver(spark: SparkSession) -> DataFrame:
    """written, book_abbr: every way to write a book. Exact names come first, then beginnings of two letters or more, of
    the longest name that has them. The table is as large as the fixed values make it, some hundred rows."""
    return spark.createDataFrame(sorted(_prefixes().items()), "written string, book_abbr string")


def books(spark: SparkSession) -> DataFrame:
    """book_no from 1, book_abbr, chapters, book (its display name)."""
    return spark.createDataFrame([(i, a, int(n), d) for i, (a, n, d, _) in enumerate(BOOKS, 1)], "book_no int, book_abbr string, chapters int, book string")


def editions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDITIONS, "version string, title string, short_title string")
