"""Detection rules and word lists, as data.

Everything in this module is a fixed value: the patterns, word lists and label
tables decide which text counts as personal data, so they have to equal the
published behaviour for results to agree.  Beyond patterns that are spelled from
these lists no logic lives here; the operators in ``detectors.py`` read the tables.

``Rule`` splits a pattern in three: ``lead`` (consumed before the value),
``value`` (the span) and ``trail`` (consumed after it).  Patterns use only
non-capturing groups.  ``jvm`` optionally holds an equivalent spelling for the
JVM engine, whose group loops recurse once per repetition: the spelling there
uses possessive loops, which do not, so that a text of any length is safe.  A match
holds one of the strings in ``needs`` and a match of ``needs_regex``, if given:
cheaper tests that spare most texts the search.  ``head`` is the class of characters a
match begins with, which the JVM asks before the word boundary: that one looks up the
Unicode types of two characters, at every place of every text.

The others spare Python a search (``functions.search``).  ``word`` is a pattern for the first
word of a match that begins at one, if it cannot be read off the pattern.  A match of a rule
with ``ends`` holds a word that ends in one of them, in any case, and consists of characters in
``run``.  One of a rule with ``pivot`` begins where the ``run`` up to a match of that pattern does.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

#: What is white space for the rules: not the separators U+001C to U+001F.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")

# How most patterns begin: a digit, a letter, a class, or one of some words.
_BEGIN = re.compile(
    r"(?:\\b)?(?:(\\d)|([A-Za-z0-9])(?![?*{])|(\[[^\]\\]+\])(?![?*]|\{0)"
    r"|\(\?:([^()|\\\[?*+.]+(?:\|[^()|\\\[?*+.]+)*)\)(?![?*{]))"
)


def first_class(pattern: str) -> str:
    """Class of the characters a match of the pattern can begin with; empty if not known."""
    found = _BEGIN.match(pattern)
    if not found:
        return ""
    digit, letter, some, words = found.groups()
    if words:
        return f"[{''.join(dict.fromkeys(w[0] for w in words.split('|')))}]"
    return digit or letter or some


# What a pattern asks of a word, part by part, and what can only stand behind a word.
_WORD_PART = re.compile(
    r"(?:\\d|[A-Za-z0-9]|\[(?:[A-Za-z0-9äöüéß]|(?<=\w)-(?=\w)|\\d)+\]|\(\?:[A-Za-zéç|]+\))"
    r"(?:\{\d+(?:,\d*)?\}|\+\+?)?+(?![?*])"
)
_BEHIND_WORD = re.compile(r"\\b|(?:\\s|\[ \]|\[[-/.\\s]+\]|[ ,-])(?![?*{])")


def first_word(pattern: str) -> str | None:
    """Pattern that the first word of every match begins with (up to ``$``, if all of the word
    is known); none if matches need not begin where a word does."""
    if not pattern.startswith(r"\b"):
        return None
    at = 2
    while part := _WORD_PART.match(pattern, at):
        at = part.end()
    known = pattern[2:at]
    return known and known + ("$" if _BEHIND_WORD.match(pattern, at) else "") or None


@dataclass(frozen=True)
class Rule:
    value: str
    lead: str = ""
    trail: str = ""
    kind: str = ""
    ignore_case: bool = False
    jvm: str | None = None
    jvm_lead: str = ""
    needs: tuple[str, ...] = ()
    needs_regex: str | None = None
    head: str | None = None
    pivot: str = ""
    run: str = ""
    word: str | None = None
    ends: tuple[str, ...] = ()

    def jvm_regex(self) -> str:
        """Groups for lead, value and trail where there is a lead or a trail;
        Unicode classes and word boundaries."""
        flags = "(?iuU)" if self.ignore_case else "(?U)"
        value = self.jvm or self.value
        begin = (self.jvm_lead or self.lead) + value
        head = first_class(begin) if self.head is None else self.head
        if head and not self.ignore_case:
            flags += f"(?={head})"
        if self.in_groups:
            return f"{flags}({self.jvm_lead or self.lead})({value})({self.trail})"
        return f"{flags}{value}"

    def first_word(self) -> str | None:
        """Pattern of the first word of every match, if matches begin where a word does."""
        return first_word((self.jvm_lead or self.lead) + (self.jvm or self.value)) if self.word is None else self.word

    def python_parts(self) -> tuple[str, str, str]:
        """Lead, value and trail for Python's ``re``: the spelling for the JVM, whose loops are
        safe there too, with flags as Python writes them.  An optional plus is told as a choice,
        since a search can then look for two characters."""

        def spelled(pattern: str) -> str:
            pattern = pattern.replace("(?-i)", "").replace("(?iu:", "(?i:")
            return re.sub(r"^\\\+\?(\d+)", r"(?:\\+\1|\1)", pattern)

        value = self.value if self.pivot else self.jvm or self.value
        return spelled(self.jvm_lead or self.lead), spelled(value), self.trail

    @property
    def in_groups(self) -> bool:
        return bool(self.lead or self.jvm_lead or self.trail)


# --- fixed values: phone numbers ------------------------------------------------
PHONE_RULES = (
    Rule(r"\b0\d{1,2}[/.\s]\d{2,3}[/.\s]\d{2}[/.\s]\d{2}\b"),
    Rule(r"\+32\s+[2-9]\s+\d{3}\s+\d{2}\s+\d{2}", needs=("+32",)),
    Rule(r"\+?32\s?\d{9}", needs=("32",)),
    Rule(r"\+?32\s?\d{3}\s?\d{2}\s?\d{2}\s?\d{2}", needs=("32",)),
    Rule(r"\b0[4-9]\d{2}[/.\s]?\d{2}[/.\s]?\d{2}[/.\s]?\d{2}\b"),
    Rule(r"\+?31\s?\d{9}", needs=("31",)),
    Rule(r"\+?31\s?6\s?\d{4}\s?\d{4}", needs=("31",)),
    Rule(r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}", needs=("(",)),
    Rule(r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"),
    Rule(r"\+?1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", needs=("1",)),
    Rule(r"\+?44\s?\d{2,4}\s?\d{3,4}\s?\d{4}", needs=("44",)),
    Rule(r"\b0\d{2,4}\s?\d{3,4}\s?\d{4}\b"),
    Rule(r"\+?33\s?\d{9}", needs=("33",)),
    Rule(r"\+?33\s?\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}", needs=("33",)),
    Rule(r"\b0\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}\b"),
    Rule(r"\+?49\s?\d{2,4}\s?\d{6,8}", needs=("49",)),
    Rule(r"\b0\d{2,4}\s?\d{6,8}\b"),
    Rule(r"\+?212\s?\d{9}", needs=("212",)),
    Rule(r"\+?79\s?\d{9}", needs=("79",)),
    Rule(r"\+\d{2,3}\s?\d{8,12}", needs=("+",)),
)

# --- fixed values: e-mail ---------------------------------------------------------
EMAIL_RULES = (
    Rule(
        r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        # A local part can only begin where its run of characters begins, which
        # keeps long runs without "@" linear.  Most places are behind a small letter, one
        # range to compare with, so that is asked first.
        jvm=r"(?:\G|(?<![a-z])(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        pivot="@",
        run=string.ascii_letters + string.digits + "._%+-",
    ),
)

# --- fixed values: bank accounts --------------------------------------------------
IBAN_RULES = (
    Rule(r"\bBE\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\b", needs=("BE",)),
    Rule(r"\bNL\d{2}\s?[A-Z]{4}\s?\d{4}\s?\d{4}\s?\d{2}\b", needs=("NL",)),
    Rule(r"\bDE\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}\b", needs=("DE",)),
    Rule(r"\bFR\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{3}\b", needs=("FR",)),
    Rule(r"\bGB\d{2}\s?[A-Z]{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}\b", needs=("GB",)),
    Rule(r"\bES\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b", needs=("ES",)),
    Rule(r"\bIT\d{2}\s?[A-Z]\d{3}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{3}\b", needs=("IT",)),
    Rule(r"\b[A-Z]{2}\d{2}\s?[A-Z0-9]{4}(?:\s?[A-Z0-9]{4}){2,6}\b"),
)


# --- fixed values: dates of birth -------------------------------------------------
DATE = r"\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}"
DATE_RULES = (Rule(r"\b" + DATE + r"\b"),)
BIRTH_WORDS = (
    "geboren op", "geboren", "geboortedatum", "geboortedatum:",
    "birth", "date of birth", "dob", "born on", "born",
    "né le", "née le", "naissance", "date de naissance",
    "geboren am", "geburtsdatum", "geb.",
    "°", "*",
)

# --- fixed values: addresses ------------------------------------------------------
ADDRESS_RULES = (
    Rule(
        r"[A-Z][a-zé]+(?:straat|laan|weg|plein|singel|dreef|lei|steenweg|kaai)[a-z]*"
        r"\s+\d+(?:/[A-Z]?\d+)?",
        needs=("straat", "laan", "weg", "plein", "singel", "dreef", "lei", "kaai"),
    ),
    Rule(r"\b[1-9]\d{3} [A-Z][a-z]+\b"),
    Rule(r"\b\d{4}\s?[A-Z]{2}\s+[A-Z][a-z]+(?:\s+\([A-Za-z]+\))?"),
    Rule(
        r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr"
        r"|Lane|Ln|Boulevard|Blvd|Way|Court|Ct|Place|Pl)\b",
        needs=("St", "Av", "Road", "Rd", "Dr", "Lane", "Ln", "Boulevard", "Blvd", "Way", "Court", "Ct", "Pl"),
    ),
    Rule(r"\b\d{5}(?:-\d{4})?\b"),
    Rule(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b", needs=(",",)),
    Rule(r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"),
    Rule(
        r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:Street|Road|Lane|Avenue|Gardens|Square"
        r"|Terrace|Close|Crescent)\b",
        needs=("Street", "Road", "Lane", "Avenue", "Gardens", "Square", "Terrace", "Close", "Crescent"),
    ),
    Rule(
        r"\b\d+\s+(?:rue|avenue|boulevard|place|allée|chemin|impasse)\s+"
        r"(?:de\s+(?:la\s+)?|du\s+|des\s+)?[A-Z][a-zé-]+(?:\s+[A-Z][a-zé-]+)*\b",
        needs=("rue", "avenue", "boulevard", "place", "allée", "chemin", "impasse"),
        jvm=r"\b\d+\s+(?:rue|avenue|boulevard|place|allée|chemin|impasse)\s+"
        r"(?:de\s+(?:la\s+)?|du\s+|des\s+)?[A-Z][a-zé-]+"
        r"(?:\s+[A-Z][a-zé-]+(?=\s+[A-Z][a-zé-]))*+(?:\s+[A-Z][a-zé-]+)?\b",
    ),
    Rule(
        r"\b\d{5}\s+[A-Z][a-zé-]+(?:-[A-Z][a-zé-]+)*\b",
        # The hyphen belongs to the word before it, so the group never repeats.
        jvm=r"\b\d{5}\s+[A-Z][a-zé-]+\b",
    ),
    Rule(
        r"\b[A-Z][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse)\s+\d+[a-z]?\b",
        needs=("straße", "strasse", "weg", "platz", "allee", "gasse"),
    ),
    Rule(r"\b\d{5}\s+[A-Z][a-zäöüß]+\b"),
)

# --- fixed values: national ids ---------------------------------------------------
ID_RULES = (
    Rule(r"\b\d{9}\b", kind="NL_BSN"),
    Rule(r"\b\d{8}[-.\s]?\d{1}\b", kind="NL_BSN"),
    Rule(r"\b\d{2}\.?\d{2}\.?\d{2}[-.\s]?\d{3}[-.\s]?\d{2}\b", kind="BE_NATIONAL"),
    Rule(r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", kind="US_SSN"),
    Rule(r"\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]\b", kind="UK_NI"),
    Rule(r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b", kind="FR_INSEE"),
    Rule(r"\b\d{2}\s?\d{6}\s?[A-Z]\s?\d{3}\s?\d\b", kind="DE_SOZVERS"),
    Rule(r"\b[A-Z]\d{8}\b", kind="DE_PERSO"),
    Rule(r"\b\d{8}[-\s]?[A-Z]\b", kind="ES_DNI"),
    Rule(r"\b[XYZ][-\s]?\d{7}[-\s]?[A-Z]\b", kind="ES_NIE"),
    Rule(r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", kind="IT_CF"),
    Rule(r"\b[A-Z]{1,2}\d{6,8}\b", kind="PASSPORT"),
)
ID_WORDS = (
    "bsn", "burgerservicenummer", "sofinummer", "sofi-nummer",
    "nationaal nummer", "rijksregisternummer", "identiteitskaartnummer",
    "national number", "id number",
    "ssn", "social security", "national insurance", "ni number",
    "passport", "driver license", "driving licence",
    "numéro de sécurité sociale", "numéro insee", "passeport",
    "sozialversicherungsnummer", "personalausweis", "reisepass",
    "dni", "nie", "documento nacional",
    "codice fiscale",
)
SSN_WORDS = ("ssn", "social security")
BSN_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, -1)

# --- fixed values: places ---------------------------------------------------------
BELGIAN_PLACES = (
    "Antwerpen", "Gent", "Brugge", "Leuven", "Mechelen", "Aalst", "Hasselt",
    "Sint-Niklaas", "Kortrijk", "Oostende", "Genk", "Roeselare", "Dendermonde",
    "Turnhout", "Lokeren", "Beveren", "Vilvoorde", "Waregem", "Ieper",
    "Herentals", "Diest", "Tongeren", "Lommel", "Tienen", "Maasmechelen",
    "Geraardsbergen", "Ninove", "Wetteren", "Brasschaat", "Beringen",
    "Temse", "Knokke-Heist", "Mol", "Aarschot", "Izegem", "Eeklo",
    "Deinze", "Halle", "Dilsen-Stokkem", "Pelt", "Zottegem", "Oudenaarde",
    "Menen", "Willebroek", "Zele", "Wevelgem", "Bree", "Bornem",
    "Brussel", "Brussels", "Bruxelles", "Schaarbeek", "Anderlecht", "Molenbeek",
    "Etterbeek", "Elsene", "Ixelles", "Ukkel", "Uccle", "Jette", "Evere",
    "Sint-Gillis", "Sint-Jans-Molenbeek", "Vorst", "Forest", "Watermaal-Bosvoorde",
    "Luik", "Liège", "Charleroi", "Namen", "Namur", "Bergen", "Mons",
    "La Louvière", "Doornik", "Tournai", "Seraing", "Verviers", "Moeskroen",
    "Châtelet", "Binche", "Soignies", "Ath", "Eupen", "Malmedy", "Arlon",
    "Zaventem", "Mortsel", "Boom", "Kapellen", "Schoten", "Wijnegem",
    "Merksem", "Deurne", "Berchem", "Hoboken", "Borgerhout", "Wilrijk",
)
DUTCH_PLACES = (
    "Amsterdam", "Rotterdam", "Den Haag", "'s-Gravenhage", "Utrecht",
    "Eindhoven", "Tilburg", "Groningen", "Almere", "Breda", "Nijmegen",
    "Enschede", "Apeldoorn", "Haarlem", "Arnhem", "Zaanstad", "Amersfoort",
    "Haarlemmermeer", "Dordrecht", "Leiden", "Zoetermeer", "Maastricht",
    "Delft", "Deventer", "Alkmaar", "Venlo", "Hilversum", "Heerlen",
    "Roosendaal", "Oss", "Schiedam", "Spijkenisse", "Helmond",
)
GERMAN_PLACES = (
    "Aken", "Aachen", "Keulen", "Köln", "Düsseldorf", "Dusseldorf",
    "Bonn", "Duisburg", "Essen", "Mönchengladbach",
)
KNOWN_PLACES = BELGIAN_PLACES + DUTCH_PLACES + GERMAN_PLACES
PREPOSITION_PLACE_RULES = (
    Rule(lead=r"(?:te|in|naar|uit|van|bij)\s+", value=r"[A-Z][a-zé-]+(?:-[A-Z][a-zé]+)?", trail=r"\b"),
)
ARTICLES = ("het", "de", "een", "dit", "dat", "deze")

FOUR_DIGITS = r"\d{4}"
CONTEXT_PLACE_RULES = (
    Rule(lead=r"\bte\s+", value=r"[A-Z][a-zA-Zé\-]+(?:\s*-\s*[A-Z][a-zA-Zé]+)?"),
    Rule(lead=r"\brichting\s+", value=r"[A-Z][a-zA-Zé\-]+", needs=("richting",)),
    Rule(lead=r"\bnaar\s+", value=r"[A-Z][a-zA-Zé\-]+", needs=("naar",)),
    Rule(lead=r"\bvanuit\s+", value=r"[A-Z][a-zA-Zé\-]+", needs=("vanuit",)),
    Rule(lead=r"\bvia\s+", value=r"[A-Z][a-zA-Zé\-]+", needs=("via",)),
    Rule(lead=r"\bt\.?h\.?v\.?\s+", value=r"[A-Z][a-zA-Zé\-]+", needs=("hv", "h.v")),
    Rule(lead=r"\bter hoogte van\s+", value=r"[A-Z][a-zA-Zé\-]+", needs=("ter hoogte van",)),
    Rule(lead=r"\b\d{4}[ ]+", value=r"[A-Z][a-zA-Zé\-]+", trail=r"\b", needs_regex=FOUR_DIGITS),
    Rule(lead=r"\b\d{4}[ ]*[A-Z]{2}[ ]+", value=r"[A-Z][a-zA-Zé\-]+", trail=r"\b", needs_regex=FOUR_DIGITS),
    Rule(value=r"\b[A-Z]{3,}", trail=r"\s+\d{4}\b", needs_regex=FOUR_DIGITS),
    Rule(lead=r"\brichting\s+", value=r"[a-zA-Z][a-zA-Zé\-]+", needs=("richting",)),
)
CONTEXT_PLACE_STOPWORDS = (
    "het", "de", "een", "van", "naar", "met", "voor", "door", "over",
    "België", "Nederland", "Duitsland", "Frankrijk",
    "Politie", "Justitie", "Parket", "Rechtbank",
    "Procureur", "Onderzoeksrechter", "Commissaris",
    "Maandag", "Dinsdag", "Woensdag", "Donderdag", "Vrijdag", "Zaterdag", "Zondag",
    "Januari", "Februari", "Maart", "April", "Mei", "Juni",
    "Juli", "Augustus", "September", "Oktober", "November", "December",
)

# --- fixed values: streets --------------------------------------------------------
_NAMED_STREET_SUFFIXES = (
    "straat", "laan", "weg", "plein", "singel", "dreef", "lei", "steenweg", "kaai", "baan",
    "dijk", "gracht", "kade", "pad", "hof", "park", "boulevard", "avenue", "ring", "markt",
)


def _by_last_letter(suffixes: tuple[str, ...]) -> dict[str, list[str]]:
    by_letter: dict[str, list[str]] = {}
    for suffix in suffixes:
        by_letter.setdefault(suffix[-1], []).append(suffix)
    return by_letter


def _ends_like_named_street() -> str:
    """Look-behind for a suffix after one more small letter, by its last letter."""
    return "|".join(
        f"(?<={letter})(?:" + "|".join(f"(?<=[a-zé]{suffix})" for suffix in suffixes) + ")"
        for letter, suffixes in _by_last_letter(_NAMED_STREET_SUFFIXES).items()
    )


NAMED_STREET_RULES = (
    Rule(
        r"\b(?:de\s+)?(?:Grote|Kleine|Oude|Nieuwe|Sint|St\.|Heilige|Lange|Korte)?\s*[A-Z][a-zé]+"
        rf"(?:{'|'.join(_NAMED_STREET_SUFFIXES)})\b",
        # Behind white space and "de" a capital has to follow.  The small letters end where
        # the word does, so the suffix is looked up only there.
        jvm=r"\b(?=[A-Z]|\s+[A-Z]|de\s+[A-Z])(?:de\s+)?"
        r"(?:Grote|Kleine|Oude|Nieuwe|Sint|St\.|Heilige|Lange|Korte)?\s*[A-Z][a-zé]++"
        rf"\b(?:{_ends_like_named_street()})",
        head=r"[dA-Z\s]",
        ends=_NAMED_STREET_SUFFIXES,
        run=string.ascii_letters + "é." + WHITE_SPACE,
    ),
    Rule(r"\b(?:Van|De|Het|Den|Ter)\s+[A-Z][a-zé]+(?:straat|laan|weg|plein)\b"),
    Rule(
        r"\b(?:Koning|Koningin|President|Generaal|Kolonel|Burgemeester|Professor|Dokter|Prins"
        r"|Prinses)\s+[A-Z][a-zé]+(?:straat|laan|weg|plein)\b"
    ),
)
STREET_SUFFIXES = (
    "straat", "laan", "weg", "plein", "singel", "dreef", "lei", "steenweg",
    "kaai", "baan", "dijk", "gracht", "kade", "pad", "hof", "park",
    "boulevard", "avenue", "ring", "passage", "markt", "poort", "dam",
    "vest", "wal", "statie", "square", "plaats", "berg", "brug",
)
_STREET_CHAR = r"[a-zA-ZéÉſKıİ\-]"  # what the class below matches in any case
_STREET_LETTER = r"[a-zA-ZéÉſKıİ]"


def _ends_like_street() -> str:
    """Look-behind for a suffix after one more character, by its last letter."""
    return "|".join(
        f"(?<=[{letter}{letter.upper()}])(?:"
        + "|".join(f"(?<={_STREET_CHAR}(?iu:{suffix}))" for suffix in suffixes)
        + ")"
        for letter, suffixes in _by_last_letter(STREET_SUFFIXES).items()
    )


ANY_STREET_RULES = (
    Rule(
        r"\b[A-Za-zé\-]+(?:" + "|".join(STREET_SUFFIXES) + r")\b",
        ignore_case=True,
        # A whole word, or its longest part before a hyphen, that ends in a
        # suffix: the suffix is looked up only there.  If the search fails from
        # the first boundary of a run it fails from all, so it starts only there: not
        # behind a small letter, which is asked first.
        jvm_lead=rf"(?-i)(?<![a-z])(?={_STREET_CHAR})(?<!{_STREET_CHAR})(?>{_STREET_CHAR}*?\b)",
        jvm=rf"(?-i)(?:{_STREET_CHAR}++(?:{_ends_like_street()})"
        rf"|(?={_STREET_LETTER}*+-){_STREET_CHAR}+(?=-)(?:{_ends_like_street()}))\b",
        ends=STREET_SUFFIXES,
        run=string.ascii_letters + "éÉſKıİ-",
    ),
)
NOT_STREETS = (
    "overlevering", "uitvoering", "niet-uitvoering", "levering", "bezorging",
    "herinnering", "verandering", "verbetering", "verklaring", "bewering",
    "ervaring", "oefening", "vergadering", "bediening", "besturing",
    "verwijdering", "verschijning", "verbinding", "beëindiging", "opening",
    "sluiting", "aflevering", "inlevering", "aanlevering", "toelevering",
    "onderweg", "halverwege", "vanwege", "wegens",
    "verlaan",
    "schadedam", "verdamdam",
    "volplein",
    "loopbaan", "rijbaan", "racebaan", "vliegbaan", "schaatsbaan",
    "wielerbaan", "omloopbaan", "glijbaan",
    "tegenpad", "voetpad", "fietspad", "wandelpad", "bospad",
    "ijsberg", "zandberg", "afvalberg", "schuldenberg",
    "paspoort", "exportpoort", "importpoort",
    "luchtbrug", "touwbrug",
    "zwemvest", "reddingsvest", "kogelvrijevest",
    "arbeidsmarkt", "huizenmarkt", "woningmarkt", "aandelenmarkt", "obligatiemarkt",
    "verblijfplaats", "woonplaats", "geboorteplaats", "werkplaats", "vindplaats",
    "bergplaats", "bewaarplaats", "opslagplaats", "parkeerplaats", "zitplaats",
    "standplaats", "ligplaats", "rustplaats", "slaapplaats", "speelplaats",
    "rechtbank", "vooruitgang", "achteruitgang",
)

# --- fixed values: person names ---------------------------------------------------
TWO_CAPITALS = r"[A-Z]{2}"
NAME_RULES = (
    Rule(
        r"\b(?:EL|VAN|DE|DER|DEN|TEN|TER)\s+[A-Z]{2,}\s+[A-Z][a-zé]+(?:\s+[A-Z][a-zé]+)?\b",
        needs_regex=TWO_CAPITALS,
    ),
    Rule(
        r"\b(?:El|Van|De|Der|Den|Ten|Ter|La|Le)\s+[A-Z][a-zé]+\s+[A-Z][a-zé]+(?:\s+[A-Z][a-zé]+)?\b"
    ),
    Rule(
        r"\b(?:Jean|Marie|Pierre|Jacques|Philippe|François|Michel|André|Louis|Charles)[-\s]"
        r"[A-Z][a-zé]+(?:\s+(?:de|du|la|le)\s+[A-Z][a-zé]+)?\b",
        needs=("Jean", "Marie", "Pierre", "Jacques", "Philippe", "François", "Michel", "André",
               "Louis", "Charles"),
    ),
    Rule(r"\b(?:de|du)\s+(?:la\s+)?[A-Z][a-zé]+\s+[A-Z][a-zé]+\b"),
    Rule(
        r"\b(?:von|zu|vom)\s+(?:der\s+)?[A-Z][a-zé]+(?:\s+[A-Z][a-zé]+)?\b",
        needs=("von", "zu", "vom"),
    ),
    Rule(r"\bO'[A-Z][a-z]+\b", needs=("O'",)),
    Rule(r"\b(?:Mc|Mac)[A-Z][a-z]+\b", needs=("Mc", "Mac")),
    Rule(r"\b[A-Z]{2,}(?:\s+[A-Z][a-zé]+){1,3}\b", needs_regex=TWO_CAPITALS),
    Rule(r"\b[A-Z][a-zé]+\s+[A-Z]{2,}\b", needs_regex=TWO_CAPITALS),
    Rule(
        r"\b(?:EL|VAN|DE)\s+(?!ERSTE|EERSTE|AANLEG|VLAANDEREN|NEDERLAND|FRANCE|GERMANY)[A-Z]{2,}\b",
        needs_regex=TWO_CAPITALS,
    ),
    Rule(
        r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
        needs=("Mr", "Ms", "Miss", "Dr", "Prof"),
    ),
)
CAPS_PAIR_RULE = 9  # position of the rule above that holds a negative look-ahead
NAME_EXCLUSIONS = (
    "VAN EERSTE", "DE EERSTE", "VAN AANLEG", "DE AANLEG",
    "VLAANDEREN", "NEDERLAND", "BELGIE", "BELGIUM",
    "PRO JUSTITIA", "EUR", "SEPA", "BTW", "BIC",
    "DE GROTE MARKT", "DE KLEINE MARKT", "DE OUDE MARKT",
    "DE GROTE PLAATS", "HET GROTE PLEIN", "DE MARKT",
    "VAN DE MARKT", "VAN HET PLEIN",
)
NAME_REGION_WORDS = ("VLAANDEREN", "NEDERLAND", "BELGIE", "AFDELING")
NAME_PLACE_ENDINGS = (
    "markt", "plein", "straat", "laan", "weg", "dreef", "lei",
    "kaai", "dijk", "gracht", "park", "bos", "hof", "tuin",
    "kerk", "station", "haven", "poort", "brug", "centrum",
)

# Names given away by what follows them.
NAME_BEFORE_DATE_RULE = Rule(
    value=r"[A-Z][A-Za-zé\'\-]+(?:\s+[A-Z]?[a-zé\'\-]+)*(?:\s+[A-Z][A-Za-zé\'\-]+)*",
    trail=r"\s*[-–]\s*" + DATE,
)
NAME_BEFORE_DATE_STOPWORDS = (
    "geboren", "geboortedatum", "datum", "nationaliteit", "wettelijke", "werkelijke",
)
CAPS_NAME_RULE = Rule(
    value=r"\b[A-Z]{3,}(?:\s+[A-Z][a-z]+)*",
    trail=r"\s*(?:[-–]\s*\d{1,2}[-/\.]|Nationaliteit|PERSON_|geboren)",
)
CAPS_NAME_STOPWORDS = (
    "PERSON", "PLACE", "STREET", "PHONE", "EMAIL", "VEHICLE", "ROAD", "PAGE",
)
NAME_BEFORE_PLACEHOLDER_RULE = Rule(
    value=r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+",
    trail=r"\s+PERSON_\d{3,4}",
)

# --- fixed values: vehicles and roads ---------------------------------------------
VEHICLE_BRANDS = (
    "fiat", "bmw", "mercedes", "mercedes-benz", "audi", "volkswagen", "vw",
    "opel", "peugeot", "renault", "citroën", "citroen", "volvo", "skoda",
    "seat", "porsche", "ferrari", "lamborghini", "alfa", "mini", "smart",
    "jaguar", "land rover", "landrover", "bentley", "rolls-royce", "aston martin",
    "maserati", "bugatti", "dacia", "lancia", "saab",
    "toyota", "honda", "nissan", "mazda", "hyundai", "kia", "suzuki",
    "mitsubishi", "lexus", "subaru", "isuzu", "daihatsu", "infiniti",
    "acura", "genesis", "ssangyong",
    "ford", "chevrolet", "chevy", "dodge", "jeep", "tesla", "cadillac",
    "chrysler", "buick", "gmc", "lincoln", "ram", "hummer",
    "iveco", "man", "daf", "scania", "renault trucks",
)
BRAND_TAIL = r"(?:\s+[A-Za-z0-9\-]+)?"
VEHICLE_MODELS = (
    "ducato", "sprinter", "transit", "transporter", "crafter", "vivaro",
    "trafic", "master", "boxer", "jumper", "daily", "vito", "caddy",
    "berlingo", "partner", "kangoo", "combo", "doblo", "nv200", "hiace",
    "golf", "polo", "passat", "corsa", "astra", "focus", "fiesta",
    "civic", "corolla", "camry", "yaris", "clio", "megane", "scenic",
    "3-serie", "5-serie", "a3", "a4", "a6", "c-klasse", "e-klasse",
)
ROAD_RULES = (Rule(r"\b[NAERnaer]\d{1,4}\b"),)

# --- fixed values: line joins, name keys, placeholders, pages ---------------------
LINE_JOIN_PARTICLES = ("EL", "VAN", "DE", "DER", "DEN", "TEN", "TER", "LA", "LE")
NAME_KEY_PARTICLES = ("EL", "AL", "VAN", "DE", "DER", "DEN", "TEN", "TER", "LA", "LE")
MASKED_VALUE = r"XX|xx|\*{3}"
PLACEHOLDER_CATEGORIES = (
    "PERSON", "PHONE", "EMAIL", "ADDRESS", "IBAN", "DOB", "ID", "ORG", "PLACE",
    "LOCATION", "STREET", "ROAD", "VEHICLE",
)
PLACEHOLDER_RULES = (Rule(r"\b(?:" + "|".join(PLACEHOLDER_CATEGORIES) + r")_\d{3,4}\b"),)
# Written like a placeholder: of any category, with any number.
ANY_PLACEHOLDER_RULE = Rule(r"\b[A-Z][A-Z_]*_\d{3,}\b")
PAGE_MARKER = r"--- Page \d+ ---"
PAGES_PER_PART = 500
CHUNK_CHARS = 500_000
SCAN_PAGE_MAX_CHARS = 50

# --- fixed values: labels of external span sources --------------------------------
LANGUAGES = ("nl", "en", "de", "fr", "it", "es")
LANGUAGE_ALIASES = {
    "dutch": "nl", "nederlands": "nl", "flemish": "nl", "vlaams": "nl",
    "english": "en", "engels": "en",
    "german": "de", "deutsch": "de", "duits": "de",
    "french": "fr", "français": "fr", "frans": "fr",
    "italian": "it", "italiano": "it", "italiaans": "it",
    "spanish": "es", "español": "es", "spaans": "es",
}
NER_LABELS = {
    "PER": "PERSON", "PERSON": "PERSON",
    "LOC": "PLACE", "GPE": "PLACE", "FAC": "PLACE",
    "ORG": "ORG", "ORGANIZATION": "ORG",
    "DATE": "DATE", "TIME": "TIME",
    "MISC": "MISC", "PRODUCT": "MISC", "EVENT": "MISC", "WORK_OF_ART": "MISC", "LAW": "MISC",
    "MONEY": "MONEY", "QUANTITY": "MISC", "PERCENT": "MISC", "CARDINAL": "MISC",
    "ORDINAL": "MISC",
    "NORP": "MISC",
}
NER_DEFAULT_CATEGORIES = ("PERSON", "PLACE", "ORG")
HYBRID_LABELS = {
    "PER": "PERSON", "PERSON": "PERSON",
    "LOC": "PLACE", "GPE": "PLACE", "FAC": "PLACE",
    "ORG": "ORG",
    "MISC": "MISC", "NORP": "MISC", "EVENT": "MISC", "PRODUCT": "MISC", "WORK_OF_ART": "MISC",
}
ANALYZER_LABELS = {
    "PERSON": "PERSON", "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON",
    "LOCATION": "PLACE", "GPE": "PLACE",
    "ORG": "ORG", "ORGANIZATION": "ORG",
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "URL": "URL", "IP_ADDRESS": "IP",
    "CREDIT_CARD": "CREDIT_CARD", "IBAN_CODE": "IBAN", "US_BANK_NUMBER": "BANK", "UK_NHS": "ID",
    "US_SSN": "ID", "US_PASSPORT": "ID", "US_DRIVER_LICENSE": "ID", "SG_NRIC_FIN": "ID",
    "AU_ABN": "ID", "AU_ACN": "ID", "AU_TFN": "ID", "AU_MEDICARE": "ID",
    "IN_PAN": "ID", "IN_AADHAAR": "ID", "IN_VEHICLE_REGISTRATION": "ID", "IN_VOTER": "ID",
    "IN_PASSPORT": "ID",
    "DATE_TIME": "DATE",
    "CRYPTO": "CRYPTO",
    "MEDICAL_LICENSE": "ID",
    "NRP": "MISC",
}
ZERO_SHOT_LABELS = {
    "person": "PERSON", "name": "PERSON", "first name": "PERSON", "last name": "PERSON",
    "location": "PLACE", "city": "PLACE", "country": "PLACE", "state": "PLACE",
    "address": "ADDRESS", "street": "STREET",
    "organization": "ORG", "company": "ORG",
    "phone number": "PHONE", "email": "EMAIL", "email address": "EMAIL",
    "ip address": "IP", "url": "URL",
    "credit card number": "CREDIT_CARD", "bank account number": "IBAN", "iban": "IBAN",
    "social security number": "ID", "passport number": "ID", "driver's license number": "ID",
    "national id": "ID", "tax id": "ID", "health insurance id": "ID",
    "medical record number": "ID", "vehicle registration": "ID", "license plate": "ID",
    "date of birth": "DOB", "date": "DATE",
    "username": "CREDENTIAL", "password": "CREDENTIAL", "api key": "CREDENTIAL",
}
ZERO_SHOT_DEFAULT_LABELS = (
    "person", "organization", "phone number", "address", "email", "credit card number",
    "social security number", "passport number", "driver's license number",
    "bank account number", "date of birth", "location", "city", "street",
)
ZERO_SHOT_EXTENDED_LABELS = ZERO_SHOT_DEFAULT_LABELS + (
    "health insurance id", "medical record number", "tax id", "national id",
    "vehicle registration", "ip address", "username", "password", "api key", "license plate",
)

# --- fixed values: legend ---------------------------------------------------------
CATEGORY_DESCRIPTIONS = {
    "PERSON": "Person names (individuals)",
    "PLACE": "Locations (cities, towns, regions)",
    "STREET": "Street names",
    "ROAD": "Road/highway numbers (N-roads, A-roads, E-roads)",
    "VEHICLE": "Vehicle brands and models (cars, vans, trucks)",
    "ADDRESS": "Full addresses",
    "PHONE": "Phone numbers",
    "EMAIL": "Email addresses",
    "IBAN": "Bank account numbers",
    "ID": "National ID numbers (BSN, etc.)",
    "DOB": "Dates of birth",
    "ORG": "Organizations",
}
LEGEND_HEAD = (
    "=" * 60,
    "DOCUMENT LEGEND - PLACEHOLDER KEY",
    "=" * 60,
    "",
    "This document has been sanitized. Sensitive data has been",
    "replaced with placeholders. Each placeholder follows the",
    "format CATEGORY_NNN (e.g., PERSON_001, PLACE_002).",
    "",
    "PLACEHOLDER CATEGORIES:",
    "",
)
LEGEND_TAIL = (
    "",
    "IMPORTANT: Different numbers = different entities.",
    "  PERSON_001 and PERSON_002 are two different people.",
    "  PLACE_001 appearing twice means the SAME location.",
    "",
    "=" * 60,
    "",
)
