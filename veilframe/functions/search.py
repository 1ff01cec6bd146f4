"""All hits of many rules in one pass over a text: the work of a task on one batch.

The JVM's ``regexp_replace`` walks every text once a rule.  Here a text is cut into words
once, and most rules are only tried where a word starts with a character they can begin with.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

from veilframe.operators.rules import Rule, first_class

#: Not white space for the rules, though it is for Python.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_BLANKED = str.maketrans(_SEPARATORS, "\x02" * len(_SEPARATORS))
_ANY_DIGIT = str.maketrans("0123456789", "5555555555")
#: Letters that equal an ASCII letter if case is ignored: long s, the Kelvin sign, i without and
#: with a dot.
_ODD_CASE = re.compile("[\u017f\u212a\u0131\u0130]")
WORD = re.compile(r"\w+")

#: Words whose rules are remembered.
MAX_KINDS = 200_000

#: Rule, lead, start, end, stop, value.
Hit = tuple[int, int, int, int, int, str]


class RuleSearch:
    """One rule as Python's ``re`` takes it, and the ways to look for it."""

    def __init__(self, rule: Rule):
        begin, value, trail = rule.python_parts()
        self.in_groups = rule.in_groups
        self.regex = re.compile(f"({begin})({value})({trail})" if rule.in_groups else value)
        self.needs = rule.needs
        self.needs_regex = re.compile(rule.needs_regex) if rule.needs_regex else None
        self.pivot = re.compile(rule.pivot) if rule.pivot else None
        self.ends = rule.ends
        self.run = rule.run
        self.rest_of_run = re.compile(f"[{re.escape(rule.run)}]*+") if rule.run else None
        word = rule.first_word()
        self.word = re.compile(word) if word else None
        self.first = first_class(begin + value) or "."

    def needed(self, text: str) -> bool:
        if self.needs and not any(n in text for n in self.needs):
            return False
        return self.needs_regex is None or bool(self.needs_regex.search(text))

    def places(self, text: str) -> Iterator[re.Match]:
        """Matches in a whole text."""
        if self.pivot is None:
            yield from self.regex.finditer(text)
            return
        end = 0
        for m in self.pivot.finditer(text):
            if m.start() < end:
                continue
            begin = end + len(text[end : m.start()].rstrip(self.run))
            found = self.regex.match(text, begin)
            if found:
                yield found
            end = found.end() if found else m.end()

    def around(self, text: str, places: Iterable[int]) -> Iterator[re.Match]:
        """Matches in the runs that hold these places."""
        end = 0
        for place in places:
            if place > end:
                begin = end + len(text[end:place].rstrip(self.run))
                end = self.rest_of_run.match(text, place).end()
                yield from self.regex.finditer(text, begin, end + 1)


class NameSearch:
    """Dictionary names in any case, found by the first word of theirs."""

    def __init__(self, names: Sequence[str], tail: str):
        ordered = sorted(names)
        words = [WORD.findall(n.lower()) for n in ordered]
        keys = [max(w, key=len) for w in words]
        self.regexes = [re.compile(rf"(?i)\b{re.escape(n)}{tail}\b") for n in ordered]
        #: None if a name does not begin with its first word.
        self.firsts = [w[0] if n[0].isalnum() else None for n, w in zip(ordered, words)]
        self.by_key: dict[str, list[int]] = {}
        for i, key in enumerate(keys):
            self.by_key.setdefault(key, []).append(i)
        self.words = {*keys, *self.firsts} - {None}

    def hits(self, text: str, words: dict[str, list[int]], odd: bool) -> list[Hit]:
        """``words`` holds the places of the words of names; none of them if case is ``odd``."""
        out = []
        for i in sorted(i for key in self.by_key.keys() & words.keys() for i in self.by_key[key]):
            regex, end = self.regexes[i], 0
            if odd or self.firsts[i] is None:
                found = regex.finditer(text)
            else:
                found = (regex.match(text, at) for at in words.get(self.firsts[i], ()))
            for m in found:
                if m and m.start() >= end:
                    start, end = m.span()
                    out.append((i, start, start, end, end, m.group()))
        return out


#: Rules to try where a word starts, rules it ends as they ask, and the word if names hold it.
Kind = tuple[list[tuple[int, Callable]], list[int], str | None]
NO_KIND: Kind = ([], [], None)


class Searches:
    """What is looked for in one pass: named sets of rules and of names."""

    def __init__(self, rules: dict[str, Sequence[Rule]], names: dict[str, tuple[Sequence[str], str]]):
        self.sets = [*rules, *names]
        self.rules = [(s, i, RuleSearch(r)) for s, of_set in enumerate(rules.values()) for i, r in enumerate(of_set)]
        self.names = [(len(rules) + n, NameSearch(*given)) for n, given in enumerate(names.values())]
        numbered = [(k, r) for k, (_, _, r) in enumerate(self.rules)]
        self.at_words = [(k, r) for k, r in numbered if r.word]
        self.ending = [(k, r) for k, r in numbered if r.ends]
        self.anywhere = [(k, r) for k, r in numbered if not r.word and not r.ends]
        self.of_names = frozenset().union(*(n.words for _, n in self.names))
        self.by_first: dict[str, list[tuple[int, RuleSearch]]] = {}
        self.kinds: dict[str, Kind] = {}

    def kind(self, word: str) -> Kind:
        # No rule tells digits apart behind the second character.
        key = word if word.isalpha() else word[:2] + word[2:].translate(_ANY_DIGIT)
        if key in self.kinds:
            known = self.kinds[key]
        else:
            first = word[0]
            if first not in self.by_first:
                self.by_first[first] = [(k, r) for k, r in self.at_words if re.match(r.first, first)]
            lowered = word.lower()
            tried = [(k, r.regex.match) for k, r in self.by_first[first] if r.word.match(word)]
            ended = [k for k, r in self.ending if lowered.endswith(r.ends)]
            known = (tried, ended, lowered if lowered in self.of_names else None)
            if len(self.kinds) > MAX_KINDS:
                self.kinds.clear()
            self.kinds[key] = known if any(known) else NO_KIND
        if word is key or known[2] is None and word.lower() not in self.of_names:
            return known
        return (*known[:2], word.lower() if word.lower() in self.of_names else None)

    def hits(self, text: str | None) -> list[list[Hit]]:
        """Hits of each set: rule order first, then text order."""
        out: list[list[Hit]] = [[] for _ in self.sets]
        if not text:
            return out
        if any(c in text for c in _SEPARATORS):
            text = text.translate(_BLANKED)
        odd = not text.isascii() and bool(_ODD_CASE.search(text))
        found: dict[int, list[re.Match]] = {}
        ends: dict[int, list[int]] = {}
        words: dict[str, list[int]] = {}
        unneeded = {k for k, r in self.at_words if r.needs and not r.needed(text)}
        known = self.kinds.get
        for m in WORD.finditer(text):
            word = m.group()
            kind = known(word) or self.kind(word)
            if kind is NO_KIND:
                continue
            at = m.start()
            tried, ended, name = kind
            for k, match in tried:
                hit = match(text, at)
                if hit and k not in unneeded:
                    before = found.get(k)
                    if before is None:
                        found[k] = [hit]
                    elif before[-1].end() <= at:
                        before.append(hit)
            for k in ended:
                ends.setdefault(k, []).append(m.end())
            if name:
                words.setdefault(name, []).append(at)
        for k, rule in self.anywhere:
            if rule.needed(text):
                found[k] = list(rule.places(text))
        for k, rule in self.ending:
            if odd:
                found[k] = list(rule.places(text))
            elif k in ends:
                found[k] = list(rule.around(text, ends[k]))
        for k in sorted(found):
            s, i, rule = self.rules[k]
            add = out[s].append
            for m in found[k]:
                if rule.in_groups:
                    add((i, m.start(), m.start(2), m.end(2), m.end(), m.group(2)))
                else:
                    start, end = m.span()
                    add((i, start, start, end, end, m.group()))
        if odd:
            words = dict.fromkeys(WORD.findall(text.lower()), [])
        for s, names in self.names:
            out[s] = names.hits(text, words, odd)
        return out
