"""All finding rules over the reading of one text, in plain Python.

The rules walk columns of a sentence's tokens; places are looked up only where a finding is made. What a sentence
lacks (a hyphen, a comma, a listed word) is asked of the whole sentence first, so that most rules look at few tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

from glossa.operators.annotate import parsed, token_spans
from glossa.operators.blocks import code_spans
from glossa.operators.dependencies import ABSTRACT, CLAUSAL, IMPERSONAL, NOT_HEADS, OBLIGATION, PASSIVE, SUBJECTS
from glossa.operators.reading import prose
from glossa.sources.profiles import STOP_LEMMAS, Profile

# Fixed values of the rules.
LIGHT_VERBS = {"carry", "conduct", "make", "perform"}
OBJECTS = {"dobj", "obj", "attr"}
PURPOSE_WRAPPERS = {"goal", "intent", "objective", "purpose"}
COMPLEMENTS = {"clear", "critical", "expected", "important", "necessary", "possible", "unclear"}
ACTOR_LIKE = {"architect", "component", "engineer", "gateway", "owner", "platform", "reviewer", "service", "system", "team"}
#: Phrase lists: rule, dimension, penalty of a match.
PHRASE_RULES = {
    "hidden_agency": ("AGENCY", "agency", 10.0), "indirect_predicates": ("INDIRECT-PREDICATE", "agency", 6.0), "weak_verbs": ("WEAK-VERB", "morphology", 7.0),
    "jargon": ("JARGON", "lexical_clarity", 6.0), "bureaucratic_phrases": ("BUREAUCRACY", "lexical_clarity", 8.0), "filler_phrases": ("FILLER", "redundancy", 4.0),
}
# End of the fixed values.
_SUBJECTS, _PASSIVE, _CLAUSAL, _NOT_HEADS, _OBLIGATION, _IMPERSONAL = map(set, (SUBJECTS, PASSIVE, CLAUSAL, NOT_HEADS, OBLIGATION, IMPERSONAL))
_VAGUE, _STOPS, _HELPERS = {*IMPERSONAL, *ABSTRACT}, set(STOP_LEMMAS), {"aux", "auxpass", "neg", "advmod"}
_CAPITALS, _ACRONYM = re.compile("[A-Z]{2}"), re.compile("([A-Z]{2,8})s?")
_DEFINED = re.compile(r"\(([A-Z]{2,8})s?\)")
_ITEM_ENDS, _WORDLIKE = re.compile(r",|\band\b|\bor\b"), re.compile(r"[^\W_]")
#: (rule_id, dimension, severity, start, end, sentence_index, observed, threshold, penalty, note)
Finding = tuple[str, str, str, int, int, int | None, float, float, float, str]


def severity(observed: float, threshold: float) -> str:
    """By the ratio to the threshold (to one where it is 0): 2 and more is high, 1.35 and more medium."""
    ratio = observed if threshold == 0 else observed / threshold
    return "high" if ratio >= 2 else "medium" if ratio >= 1.35 else "low"


def punctuation_depth(text: str) -> int:
    brackets = sum(map(text.count, "()[]"))
    return 2 * (brackets // 2) + 2 * text.count(";") + text.count("—") + text.count("–") + max(0, text.count(",") - 2)


class _Nominal(dict):
    """Whether the words met lately are abstract action nouns: listed ones and those with a listed ending, but for the exclusions; a plural counts as its singular."""

    def __init__(self, excluded: set[str], named: set[str], endings: tuple[str, ...]):
        self.excluded, self.named, self.endings = excluded, named, endings

    def __missing__(self, word: str) -> bool:
        if len(self) >= 1 << 16:
            self.clear()
        one = word[:-1] if len(word) > 4 and word.endswith("s") else word
        made = self[word] = word not in self.excluded and one not in self.excluded and (word in self.named or one in self.named or one.endswith(self.endings))
        return made


class Rules:
    """The rules of one policy."""

    def __init__(self, profile: Profile):
        words = lambda key: set(profile.words(key))
        self.t = profile.thresholds
        self.actors, self.evidence, self.qualifiers, self.allowed, self.modifiers = map(words, ("actor_terms", "abstract_evidence_heads", "qualifiers", "allowed_compounds", "compound_modifier_suffixes"))
        self.acronyms = set(profile.rules["known_acronyms"])
        self.strict, self.implied = profile.flag("require_responsible_actor"), profile.flag("allow_implied_subject", "allow_implied_first_person")
        self.across = profile.flag("count_repetition_across_blocks")
        self.groups: dict[str, str] = {}  # each action word's group, the first by label
        for label, listed in sorted(profile.phrases("recommendation_action_groups").items()):
            for w in listed:
                self.groups.setdefault(w.lower(), label)
        self.dull = {*STOP_LEMMAS, *self.actors, *OBLIGATION}
        #: first term -> (place in the table, terms, key, label); hyphens part terms.
        self.phrases: dict[str, list[tuple[int, list[str], str, str]]] = {}
        table = [(key, label, p.lower().replace("-", " ").split()) for key in [*PHRASE_RULES, "purpose_markers"] for label, ps in sorted(profile.phrases(key).items()) for p in sorted(ps)]
        for place, (key, label, terms) in enumerate(table):
            if terms:
                self.phrases.setdefault(terms[0], []).append((place, terms, key, label))
        self.firsts, self.wanted = set(self.phrases), {w: [set(p[1]) for p in ps] for w, ps in self.phrases.items()}
        self.nominal = _Nominal(words("nominalization_exclusions"), words("nominalizations"), tuple(profile.words("nominalization_suffixes")))

    def over(self, rule: str, dimension: str, start: int, end: int, sentence: int | None, observed: int, threshold: float, most: float, each: float, note: str = "") -> Finding:
        """The finding of a number that is over its threshold."""
        o = float(observed)
        return f"LING-{rule}-001", dimension, severity(o, float(threshold)), start, end, sentence, o, float(threshold), min(float(most), (o - threshold) * each), note

    def hits(self, lemmas: list[str], low: list[str], words: list[int], hyphens: bool) -> list[tuple[int, int, int, str, str]]:
        """(place in the table, first token, last token, key, label): where the lemmas of neighbouring words are a phrase's terms, marks between them skipped."""
        at, terms = words, [lemmas[i] for i in words]
        if hyphens:
            split = [(x, i) for i in words for x in (low[i].split("-") if "-" in low[i] else (lemmas[i],))]
            terms, at = [x for x, _ in split], [i for _, i in split]
        found, first = [], self.phrases
        for k, term in enumerate(terms):
            if term in first:
                for place, wanted, key, label in first[term]:
                    n = len(wanted)
                    if n == 1 or (k + n <= len(terms) and terms[k + 1] == wanted[1] and terms[k : k + n] == wanted):
                        found.append((place, at[k], at[k + n - 1], key, label))
        found.sort(key=lambda h: h[0])
        return found

    def sentence(self, text: str, x: int, y: int, index: int, defined: set[str]) -> tuple[list[Finding], list[str], list[int], int, tuple[str, set[str]] | None, Callable]:
        """(findings, lemmas, word tokens, undefined acronyms, a directive's action group and terms, places of tokens) of one sentence."""
        s, t, nominal = text[x:y], self.t, self.nominal
        texts, low, lemma, pos, dep, head = parsed(s)
        n = len(texts)
        words = [i for i, p in enumerate(pos) if p != "PUNCT"]
        lemmas, lows = set(lemma), set(low)
        kids: list[list[int]] = [[] for _ in texts]
        for i, h in enumerate(head):
            if i != h:
                kids[h].append(i)
        expletive = False
        if "there" in lows:
            for i, w in enumerate(low[:-1]):
                if w == "there" and lemma[i + 1] == "be":
                    dep[i], expletive = "expl", True
        commas, hyphens = "," in s, "-" in s
        spans: list[tuple[int, int]] = []

        def place(first: int, last: int) -> tuple[int, int]:
            if not spans:
                spans.extend(token_spans(s))
            return x + spans[first][0], x + spans[last][1]

        def made(rule: str, dimension: str, level: str, at: tuple[int, int], observed: float, threshold: float, penalty: float, note: str = "") -> Finding:
            return f"LING-{rule}-001", dimension, level, *at, index, float(observed), float(threshold), float(penalty), note

        whole, out = (x, y), []
        hits = self.hits(lemma, low, words, hyphens) if hyphens or any(p <= lemmas for w in self.firsts & lemmas for p in self.wanted[w]) else []
        phrases = [made(*PHRASE_RULES[key][:2], "medium", place(a, b), 1.0, 0.0, PHRASE_RULES[key][2], label) for _, a, b, key, label in hits if key in PHRASE_RULES] if hits else []

        # verbs
        verbs = [i for i, p in enumerate(pos) if p == "VERB"]
        actions, clauses, passives, directive, weak = 0, 1, [], None, []
        for v in verbs:
            d, below = dep[v], kids[v]
            subjects = [k for k in below if dep[k] in _SUBJECTS]
            bound = any(dep[k] == "aux" and lemma[k] in _OBLIGATION for k in below)
            if d not in _NOT_HEADS:
                who = subjects[0] if subjects else None
                if who is None or not commas or "," not in texts[who + 1 : v] or pos[who] in ("PRON", "PROPN") or lemma[who] in ACTOR_LIKE:
                    actions += 1
            if d in _CLAUSAL or d == "conj" and pos[head[v]] == "VERB":
                clauses += 1
            if d not in ("amod", "acomp") and any(dep[k] in _PASSIVE for k in below):
                first = min([v, *(k for k in below if dep[k] in _HELPERS)])
                vague = subjects and lemma[subjects[0]] in _VAGUE
                passives.append((*place(first, v), lemma[v], (vague or bound) and not any(dep[k] == "agent" for k in below)))
            if directive is None and (bound or v == words[0] and low[v] == lemma[v] and all(lemma[k] in _IMPERSONAL for k in subjects)):
                directive = v
            if lemma[v] in LIGHT_VERBS and (lemma[v] != "carry" or any(lemma[k] == "out" for k in below)):
                thing = next((k for k in below if dep[k] in OBJECTS and pos[k] == "NOUN" and nominal[lemma[k]]), None)
                if thing is not None:
                    weak.append((v, thing))
        for v in verbs:
            for c in kids[v]:
                if dep[c] == "xcomp":
                    things = [k for k in kids[c] if dep[k] in OBJECTS]
                    if any(pos[k] == "NOUN" and nominal[lemma[k]] for k in things):
                        weak.append((v, things[-1]))

        # numbers over their thresholds
        def over(rule: str, dimension: str, observed: int, name: str, most: float, each: float, at: tuple[int, int] = whole, note: str = "") -> None:
            if observed > t[name]:
                out.append(self.over(rule, dimension, *at, index, observed, t[name], most, each, note))

        over("SENTENCE", "sentence_load", len(words), "max_sentence_words", 30, 1.5)
        over("ACTION", "sentence_load", actions, "max_actions_per_sentence", 24, 6)
        over("CLAUSE", "sentence_load", clauses, "max_clauses_per_sentence", 18, 4)
        over("PUNCTUATION", "sentence_load", punctuation_depth(s), "max_punctuation_depth", 14, 2)
        nouns = [i for i, p in enumerate(pos) if p == "NOUN"]
        over("NOMINALIZATION", "morphology", sum([nominal[lemma[i]] for i in nouns]), "max_nominalizations_per_sentence", 25, 5)
        if commas and s.count(",") + s.count("and") + s.count("or") >= t["max_inline_list_items"]:
            over("LIST", "structure", sum(1 for i in _ITEM_ENDS.split(s) if _WORDLIKE.search(i)), "max_inline_list_items", 12, 2)
        purposes = sorted({label for _, _, _, key, label in hits if key == "purpose_markers"})
        over("MIXED-PURPOSE", "structure", len(purposes), "max_sentence_purposes", 14, 4, note=", ".join(purposes))
        unknown = self.undefined(texts, defined) if _CAPITALS.search(s) else []
        if len(unknown) > t["max_undefined_acronyms_per_sentence"]:
            over("ABBREVIATION", "lexical_clarity", len(unknown), "max_undefined_acronyms_per_sentence", 12, 3, place(unknown[0], unknown[-1]))

        # who acts
        out += [made("PASSIVE", "agency", "medium", (a, b), 1.0, 0.0, 8.0, note) for a, b, note, _ in passives]
        agency = [f for f in phrases if f[0] == "LING-AGENCY-001"]
        listed = {(f[3], f[4]) for f in agency}
        agency += [made("AGENCY", "agency", "medium", (a, b), 1.0, 0.0, 10.0, "agentless passive") for a, b, _, bare in passives if bare and (a, b) not in listed]
        out += agency
        hidden = lambda a, b: any(a < f[4] and b > f[3] for f in agency)
        if directive is not None and not hidden(x, y) and self.actorless(directive, low, lemma, pos, dep, head, kids):
            out.append(made("ACTOR", "agency", "medium", whole, 0.0, 1.0, 7.0, low[directive]))
        indirect = [f for f in phrases if f[0] == "LING-INDIRECT-PREDICATE-001"]
        if expletive or ("it" in lemmas or not PURPOSE_WRAPPERS.isdisjoint(lemmas)) and self.wrapped(lemma, pos, dep, head, kids):
            indirect.append(made("INDIRECT-PREDICATE", "agency", "medium", whole, 1.0, 0.0, 6.0, "expletive"))
        out += [f for f in indirect if not hidden(f[3], f[4])]

        # words
        out += [made("WEAK-VERB", "morphology", "medium", place(a, b), 1.0, 0.0, 7.0, "light verb") for a, b in dict.fromkeys(weak)]
        out += [f for f in phrases if f[0] not in ("LING-AGENCY-001", "LING-INDIRECT-PREDICATE-001")]
        if not (self.evidence.isdisjoint(lemmas) and self.evidence.isdisjoint(lows)):
            for h in range(n):
                if lemma[h] in self.evidence or low[h] in self.evidence:
                    evident = [c for c in kids[h] if c < h and dep[c] == "compound" and pos[c] == "NOUN" and nominal[lemma[c]]]
                    out += [made("JARGON", "lexical_clarity", "medium", place(c, h), 1.0, 0.0, 6.0, "abstract evidence phrase") for c in evident]
        self.stacks(low, pos, dep, head, place, made, out)
        if hyphens:
            jargon = [place(a, b) for _, a, b, key, _ in hits if key == "jargon"]
            for i in words:
                if "-" in low[i] and low[i] not in self.allowed:
                    self.compound(low[i], place(i, i), index, jargon, out)
        if not (self.qualifiers.isdisjoint(lemmas) and self.qualifiers.isdisjoint(lows)):
            q = [i for i in range(n) if lemma[i] in self.qualifiers or low[i] in self.qualifiers]
            near = next(((a, b) for a, b in zip(q, q[1:]) if b == a + 1), None)
            if near:
                out.append(made("QUALIFIER", "redundancy", "medium", place(*near), 2.0, 1.0, 5.0, "stacked"))
            elif len(q) >= 2:
                over("QUALIFIER", "redundancy", len(q), "max_qualifiers_per_sentence", 10, 3, place(q[0], q[-1]))

        action = None
        if directive is not None:
            group = next((self.groups[lemma[v]] for v in verbs if lemma[v] in self.groups), None)
            if group is not None:
                action = group, {lemma[i] for i in words if len(lemma[i]) >= 5 and lemma[i] not in self.dull and pos[i] not in ("AUX", "DET")}
        return out, lemma, words, len(unknown), action, place

    def undefined(self, texts: list[str], defined: set[str]) -> list[int]:
        """Tokens that are undefined acronyms: two to eight capitals, a plural s taken off."""
        named = ((i, _ACRONYM.fullmatch(w)) for i, w in enumerate(texts))
        return [i for i, m in named if m and m[1] not in self.acronyms and m[1] not in defined]

    def actorless(self, v: int, low, lemma, pos, dep, head, kids) -> bool:
        """Whether a directive names nobody who acts."""

        def actor(k: int) -> bool:
            return lemma[k] in self.actors or low[k] in self.actors or pos[k] == "PROPN" or pos[k] == "PRON" and lemma[k] not in _IMPERSONAL

        own = [k for k in kids[v] if dep[k] in _SUBJECTS]
        subjects = own or ([k for k in kids[head[v]] if dep[k] in _SUBJECTS] if dep[v] == "conj" else [])
        if self.implied and not subjects:
            return False
        if self.strict:
            named = [*subjects, *(c for k in subjects for c in kids[k] if dep[c] == "conj")]
            return not any(map(actor, named))
        return not any(d in _SUBJECTS and actor(k) for k, d in enumerate(dep)) and all(lemma[k] in _IMPERSONAL for k in own)

    def wrapped(self, lemma, pos, dep, head, kids) -> bool:
        """"It is clear that" and "the purpose of ... is to ..."."""
        for i, m in enumerate(lemma):
            if dep[i] not in _SUBJECTS:
                continue
            beside = kids[head[i]]
            if m == "it" and any(lemma[c] in COMPLEMENTS for c in beside) and any(dep[c] == "ccomp" for c in beside):
                return True
            if m in PURPOSE_WRAPPERS and any(dep[c] == "prep" and lemma[c] == "of" for c in kids[i]) and any(dep[c] == "xcomp" and pos[c] == "VERB" for c in beside):
                return True
        return False

    def stacks(self, low, pos, dep, head, place, made, out: list[Finding]) -> None:
        """Runs of nominal modifiers that end at their head noun."""
        least = int(self.t["noun_stack_words"])
        back = max(least - 1, 1)
        for h in range(back, len(dep)):
            if head[h - 1] != h or head[h - back] != h or dep[h] == "compound" or pos[h] not in ("NOUN", "PROPN"):
                continue
            k = h
            while k and head[k - 1] == h and (dep[k - 1] == "compound" and pos[k - 1] in ("NOUN", "PROPN", "VERB") or dep[k - 1] == "amod" and pos[k - 1] in ("NOUN", "PROPN")):
                k -= 1
            depth = h - k + 1
            if depth > back:
                out.append(made("NOUN-STACK", "morphology", severity(float(depth), float(least)), place(k, h), depth, least - 1, min(12.0, 3.0 + (depth - 3) * 2.0), low[h]))

    def compound(self, term: str, at: tuple[int, int], index: int, jargon: list[tuple[int, int]], out: list[Finding]) -> None:
        """Deep hyphenated terms; of the others those of three parts or with a listed modifier at the end, unless jargon is there."""
        pieces = term.split("-")
        parts, most = len(pieces), self.t["max_compound_parts"]
        if parts > most:
            out.append(self.over("COMPOUND-DEPTH", "morphology", *at, index, parts, most, 10, 3, term))
        elif not any(at[0] < b and at[1] > a for a, b in jargon) and (parts >= 3 or pieces[-1] in self.modifiers):
            level, penalty = ("medium", 6.0) if parts >= 3 else ("low", 4.0)
            out.append(("LING-COMPOUND-001", "lexical_clarity", level, *at, index, float(parts), 1.0, penalty, term))

    def repeats(self, content: list[tuple[str, object, int]]) -> list[Finding]:
        """Content lemmas that come too often; the first place counts."""
        most, first = self.t["max_repeated_content_word"], {}
        counts = Counter(lemma for lemma, _, _ in content)
        again = {lemma for lemma, n in counts.items() if n > 1 and n > most}
        if not again:
            return []
        for lemma, place, i in content:
            if lemma in again and lemma not in first:
                first[lemma] = place(i, i)
        return [("LING-REDUNDANCY-001", "redundancy", "low", *at, None, float(counts[m]), float(most), min(10.0, (counts[m] - most) * 2.0), m) for m, at in first.items()]

    def framing(self, short: list[tuple[int, int, int, set[str]]], items: list[int]) -> list[Finding]:
        """Short prose blocks (index, start, end, terms) that repeat an earlier one's terms, with a list item between."""
        t, out, low = self.t, [], 0
        least = t["min_duplicate_framing_shared_terms"]
        for k, (index, start, end, terms) in enumerate(short):
            while index - short[low][0] > t["max_duplicate_framing_block_distance"]:
                low += 1
            for before, _, _, others in short[low:k]:
                alike = len(terms & others)
                if alike >= least and alike / min(len(terms), len(others)) >= t["min_duplicate_framing_similarity"] and items[index] > items[before + 1]:
                    out.append(("LING-DUPLICATED-FRAMING-001", "redundancy", "medium", start, end, None, float(alike), float(least), 6.0, f"block {before}"))
                    break
        return out

    def text(self, text: str) -> tuple[int, list[Finding]]:
        """(words, findings in order of place) of a text; findings inside code or an opaque block go, equal ones collapse."""
        t, defined = self.t, set(_DEFINED.findall(text))
        found, of_blocks, code, short, everything = [], [], [], [], []
        items, acted, total, index = [], {}, 0, 0  # items: list items before each block
        recommended: list[Finding] = []
        blocks = list(prose(text))
        framed = any(b.kind == "list_item" for _, b, _ in blocks)
        for number, b, spans in blocks:
            items.append((items[-1] if items else 0) + (number > 0 and was == "list_item"))
            was = b.kind
            if spans is None:
                code.append((b.start, b.end))
                continue
            if "`" in text[b.start : b.end]:
                code += [(b.start + x, b.start + y) for x, y in code_spans(text[b.start : b.end])]
            content, seen, n_words, unknown, told = [], [], 0, 0, False
            for x, y in spans:
                out, lemma, words, n, action, place = self.sentence(text, x, y, index, defined)
                found += out
                n_words += len(words)
                unknown += n
                told = told or n > t["max_undefined_acronyms_per_sentence"]
                content += [(m, place, i) for i in words if len(m := lemma[i]) >= 7 and m not in _STOPS]
                if framed:
                    seen.append((lemma, words))
                if action is not None:
                    group, terms = action
                    earlier = acted.setdefault(group, set())
                    if not earlier.isdisjoint(terms):
                        recommended.append(("LING-DUPLICATED-RECOMMENDATION-001", "redundancy", "medium", x, y, index, 1.0, 0.0, 8.0, group))
                    earlier |= terms
                index += 1
            total += n_words
            if n_words > t["max_paragraph_words"]:
                of_blocks.append(self.over("STRUCTURE", "structure", b.start, b.end, None, n_words, t["max_paragraph_words"], 20, 0.75))
            if n_words and not told and unknown > t["max_undefined_acronyms_per_paragraph"]:
                of_blocks.append(self.over("ABBREVIATION", "lexical_clarity", b.start, b.end, None, unknown, t["max_undefined_acronyms_per_paragraph"], 12, 2))
            if self.across:
                everything += content
            else:
                of_blocks += self.repeats(content)
            if framed and b.kind == "prose" and n_words <= t["max_duplicate_framing_words"]:
                terms = {m for lemma, words in seen for i in words if len(m := lemma[i]) >= 4 and m not in _STOPS}
                if len(terms) >= max(1, t["min_duplicate_framing_shared_terms"]):
                    short.append((number, b.start, b.end, terms))
        if self.across:
            of_blocks += self.repeats(everything)
        if framed:
            of_blocks += self.framing(short, items)
        whole = found + of_blocks + recommended
        if code:
            starts = [a for a, _ in code]
            whole = [f for f in whole if not ((k := bisect_right(starts, f[3])) and f[4] <= code[k - 1][1])]
        return total, sorted(dict.fromkeys(whole), key=lambda f: (f[3], f[4], f[0], f[9]))
