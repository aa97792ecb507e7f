"""A deterministic annotator: lemmas, parts of speech and shallow dependencies of English sentences.

It is a stand-in behind an interface: anything that gives the same token columns can take its place, and
``ENGINE`` says which one made a table. Closed classes come from lists, open ones from endings and
neighbours. Dependencies follow clauses: noun groups, the verb group's subject, object, agent and
prepositional objects. It does not try to be a statistical parser.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENGINE = "glossa-shallow 1.0.0"
_TOKEN = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*|[^\w\s]|_+")
#: The tokens with letters or digits; all others are marks.
WORD_TOKEN = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")
DET = set("the a an this that these those each every any some no all both either neither its their our your his her my".split())
PRON = set("i you he she it we they them us him me who which there nobody everyone someone".split())
ADP = set("of in on at by for with from to into onto over under before after until between during without within through about against as per via".split())
MODAL = {"must": "must", "shall": "shall", "should": "should", "may": "may", "might": "might", "will": "will", "would": "would", "can": "can", "could": "could", "cannot": "can"}
BE = set("be is are was were been being am".split())
HAVE, DO = set("have has had having".split()), set("do does did doing".split())
CONJ = set("and or but nor".split())
MARK = set("that if because although while when once unless whether".split())
NEG = set("not never n't".split())
ADV = set("also again already now then very quickly soon yet only still just well here".split())
VERBS = set(
    "accept address adopt allow apply approve ask assess assign audit begin block build call cause change check clear close come complete conduct confirm consider create decide defer define delay deliver deny deploy "
    "depend describe design document drop ensure evaluate expect explain fail fix follow get give go grant happen harden hold implement improve include investigate keep know launch lead leave let make manage measure mention "
    "meet merge migrate mitigate monitor move need note observe open own patch perform plan postpone prevent propose protect prove provide publish put quarantine ratify reach read receive recommend record reduce reject release rely "
    "agree begin believe bring buy carry decline help join learn lose offer pay prepare promise raise refer save say sell serve share ship show spend stay suggest teach tell think try turn understand visit want "
    "remain remediate remove replace report require resolve restore retain return review run schedule see send set sign start state stop submit support take test track treat update use validate verify wait waive want work write".split()
)
IRREGULAR = {"made": "make", "took": "take", "taken": "take", "gave": "give", "given": "give", "wrote": "write", "written": "write", "built": "build", "held": "hold", "kept": "keep", "met": "meet", "sent": "send", "known": "know", "seen": "see", "begun": "begin", "began": "begin", "left": "leave", "led": "lead", "chosen": "choose", "found": "find", "ran": "run", "went": "go", "done": "do", "said": "say", "told": "tell", "paid": "pay", "sold": "sell", "bought": "buy", "brought": "bring", "lost": "lose", "shown": "show", "spent": "spend", "thought": "think", "understood": "understand"}
NUMBERS = set("one two three four five six seven eight nine ten".split())
GREEK = set("analyses crises diagnoses emphases hypotheses parentheses syntheses theses".split())
_NOT_AFTER_ADJ = DET | ADP | CONJ | BE | set(MODAL)
ADJ_ENDS = ("able", "ible", "ful", "less", "ous", "ive", "ical", "al", "ic")


@lru_cache(1 << 15)
def verb_lemma(word: str) -> str | None:
    """The base of a known verb's form, or None."""
    if word in VERBS:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    for end, adds in (("ies", ("y",)), ("ied", ("y",)), ("es", ("", "e")), ("s", ("",)), ("ed", ("", "e")), ("ing", ("", "e"))):
        if word.endswith(end):
            base = word[: -len(end)]
            for add in adds:
                if base + add in VERBS:
                    return base + add
            if len(base) > 2 and base[-1] == base[-2] and base[:-1] in VERBS:
                return base[:-1]
    return None


@lru_cache(1 << 15)
def noun_lemma(word: str) -> str:
    if word in GREEK:
        return word[:-2] + "is"
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("ches", "shes", "sses", "xes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3 else word


_OPEN, _TO, _THAT = "open", "to", "that"
_CUES, _GROUP, _IN_GROUP = {"DET", "ADJ", "NUM"}, {"DET", "ADJ", "NUM", "NOUN", "PROPN", "PRON"}, {"ADJ", "NUM", "NOUN", "PROPN"}
_BEFORE_VERB = {"AUX", "PART", "ADV", "PRON", "CCONJ", "PUNCT", "SCONJ"}
_MODIFIER = {"DET": "det", "ADJ": "amod", "NUM": "nummod"}
_LEFT_OVER = {"PUNCT": "punct", "CCONJ": "cc", "SCONJ": "mark", "ADP": "prep"}


def _by_itself(text: str) -> tuple:
    """What a token is whatever stands beside it: (lower case, part of speech, lemma, a verb's base form, what an adjective may stand before, and of open words their forms)."""
    w = text.lower()
    base = verb_lemma(w)
    letters = any(c.isalnum() for c in w)
    if not letters:
        pos, lemma = "PUNCT", w
    elif w in NEG:
        pos, lemma = "PART", "not" if w == "n't" else w
    elif w in MODAL:
        pos, lemma = "AUX", MODAL[w]
    elif w in BE or w in HAVE or w in DO:
        pos, lemma = "AUX", "be" if w in BE else "have" if w in HAVE else "do"
    elif w in CONJ:
        pos, lemma = "CCONJ", w
    elif w == "to":
        pos, lemma = _TO, w
    elif w in PRON:
        pos, lemma = "PRON", w
    elif w in DET:
        pos, lemma = _THAT if w == "that" else "DET", w
    elif w in MARK:
        pos, lemma = "SCONJ", w
    elif w in ADP:
        pos, lemma = "ADP", w
    elif w[0].isdigit() or w in NUMBERS:
        pos, lemma = "NUM", w
    elif w in ADV or (w.endswith("ly") and len(w) > 4):
        pos, lemma = "ADV", w
    else:
        pos, lemma = _OPEN, noun_lemma(w)
    forms = None
    if pos is _OPEN:
        irregular, adjective = w in IRREGULAR, w.endswith(ADJ_ENDS)
        after_be = (w[:-2] if w.endswith("ed") and not w.endswith("eed") else w) if w.endswith(("ed", "en")) else None
        forms = base, base == w and not irregular, w.endswith("ing"), irregular or w.endswith(("ed", "s")), adjective, text[0].isupper(), after_be
    return w, pos, lemma, base == w, any(c.isalnum() for c in text) and w not in _NOT_AFTER_ADJ, forms


class _Lexicon(dict):
    """``_by_itself`` of the tokens met lately, by text."""

    def __missing__(self, text: str) -> tuple:
        if len(self) >= 1 << 16:
            self.clear()
        made = self[text] = _by_itself(text)
        return made


_LEXICON = _Lexicon()


def token_spans(sentence: str) -> list[tuple[int, int]]:
    """Where the tokens of a sentence begin and end."""
    return [m.span() for m in _TOKEN.finditer(sentence)]


def parsed(sentence: str) -> tuple[list[str], list[str], list[str], list[str], list[str], list[int]]:
    """Columns over the tokens of a sentence: text, text in lower case, lemma, pos, dep, head (its own index for a root)."""
    texts = _TOKEN.findall(sentence)
    known = list(map(_LEXICON.__getitem__, texts))
    n, low, lemmas, tags = len(texts), [e[0] for e in known], [], []
    before, before_lemma = None, None  # of the token before
    for i, (w, pos, lemma, _, _, forms) in enumerate(known):
        if pos is _OPEN:
            base, bare, ing, verb_end, adjective, upper, after_be = forms
            if bare and before_lemma == "be":
                pos, lemma = "ADJ", w
            elif base and not (before in _CUES or before == "ADP" and low[i - 1] != "to") and not (ing and before is not None and before not in ("AUX", "PART")):
                # a plural before a base form is its subject
                verbal = before is None or verb_end or before in _BEFORE_VERB or before == "NOUN" and low[i - 1] != before_lemma
                pos, lemma = ("VERB", base) if verbal else ("NOUN", lemma)
            elif adjective and i + 1 < n and known[i + 1][4]:
                pos, lemma = "ADJ", w
            elif upper and i:
                pos, lemma = "PROPN", w
            elif before_lemma == "be" and (after_be is not None or adjective):
                pos, lemma = ("VERB", after_be) if after_be is not None else ("ADJ", w)
            else:
                pos = "NOUN"
        elif pos is _TO:
            pos = "PART" if i + 1 < n and known[i + 1][3] else "ADP"
        elif pos is _THAT:
            pos = "SCONJ" if before in ("VERB", "AUX") else "DET"
        tags.append(pos)
        lemmas.append(lemma)
        before, before_lemma = pos, lemma
    deps, heads = _attached(low, lemmas, tags)
    return texts, low, lemmas, tags, deps, heads


def annotate(sentence: str) -> list[dict]:
    """Tokens of a sentence: index, text, start, lemma, pos, dep, head (its own index for a root)."""
    texts, _, lemmas, tags, deps, heads = parsed(sentence)
    rows = enumerate(zip(texts, token_spans(sentence), lemmas, tags, deps, heads, strict=True))
    return [{"index": i, "text": x, "start": s, "lemma": m, "pos": p, "dep": d, "head": h} for i, (x, (s, _), m, p, d, h) in rows]


def _attached(low: list[str], lemma: list[str], pos: list[str]) -> tuple[list[str], list[int]]:
    """Relations and heads, group by group."""
    n = len(pos)
    dep, head = ["dep"] * n, list(range(n))
    firsts: dict[int, int] = {}  # noun groups: head to first token
    head_of: dict[int, int] = {}
    verbs, i, j = [], 0, None
    while i < n:
        if pos[i] in _GROUP:
            j = i
            if pos[i] != "PRON":
                while j + 1 < n and pos[j + 1] in _IN_GROUP:
                    j += 1
            for k in range(i, j):
                head[k], dep[k] = j, _MODIFIER.get(pos[k], "compound")
            firsts[j], head_of[i] = i, j
            i = j + 1
        else:
            if pos[i] == "VERB":
                verbs.append(i)
            i += 1
    if not verbs:  # a state: the first form of "be" leads
        verbs = [pos.index("AUX")] if "AUX" in pos else []
    root = verbs[0] if verbs else 0 if j is None else j
    last_clause = 0
    for v, verb in enumerate(verbs):
        k, passive, infinitive = verb - 1, False, False
        while k >= last_clause and pos[k] in ("AUX", "PART", "ADV"):
            be = lemma[k] == "be"
            passive |= be and pos[verb] == "VERB" and not low[verb].endswith("ing")
            head[k], dep[k] = verb, "neg" if lemma[k] in NEG else "auxpass" if be and passive else "advmod" if pos[k] == "ADV" else "aux"
            infinitive |= low[k] == "to"
            k -= 1
        if k >= 0 and low[k] == "to" and head[k] == verb:
            infinitive = True
        joined = k >= 0 and pos[k] == "CCONJ"
        if not infinitive and not joined:
            for s in range(k, last_clause - 1, -1):
                if s in firsts and dep[s] == "dep" and not (firsts[s] and pos[firsts[s] - 1] == "ADP"):
                    head[s], dep[s] = verb, "nsubjpass" if passive else "nsubj"
                    break
        if verb != root:
            head[verb] = verbs[v - 1]
            if infinitive:
                dep[verb] = "xcomp"
            elif joined or "SCONJ" not in pos[verbs[v - 1] : verb]:
                dep[verb] = "conj"
            else:
                between = low[verbs[v - 1] : verb]
                dep[verb] = "ccomp" if "that" in between or "whether" in between else "advcl"
        else:
            dep[verb] = "ROOT"
        end = verbs[v + 1] if v + 1 < len(verbs) else n
        got_object, parted = passive or pos[verb] == "AUX", None  # parted: the last mark or conjunction before the next verb
        m = verb + 1
        while m < end:
            p = pos[m]
            if p == "ADP":
                head[m], dep[m] = verb, "agent" if passive and low[m] == "by" else "prep"
                obj = head_of.get(m + 1)
                if obj is not None:
                    head[obj], dep[obj] = m, "pobj"
                    m = obj
            elif dep[m] == "dep":
                if m in firsts:
                    if got_object and end < n and parted is None:
                        parted = next((x for x in range(end - 1, verb, -1) if pos[x] in ("CCONJ", "SCONJ", "PUNCT")), verb)
                    if not (got_object and end < n and parted < m):
                        head[m], dep[m] = verb, "attr" if pos[verb] == "AUX" else "conj" if got_object else "dobj"
                        got_object = True
                elif p in ("ADV", "PART"):
                    head[m], dep[m] = verb, "neg" if lemma[m] in NEG else "advmod"
                elif p == "ADJ":
                    head[m], dep[m] = verb, "acomp"
            m += 1
        last_clause = verb + 1
    if n and not verbs:
        dep[root] = "ROOT"
    for i, d in enumerate(dep):
        if d == "dep":
            head[i] = root
            dep[i] = _LEFT_OVER.get(pos[i]) or ("ROOT" if i == root else "dep")
    return dep, head


_KIND = "array<struct<index: int, text: string, start: int, lemma: string, pos: string, dep: string, head: int>>"
_ARROW = pa.list_(pa.struct([("index", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("lemma", pa.string()), ("pos", pa.string()), ("dep", pa.string()), ("head", pa.int32())]))


def tokens(sent: DataFrame) -> DataFrame:
    """Annotated tokens of (doc_id, sentence_index, sentence); index and head count through the document.

    A million numbers are set apart for each sentence, so that no sentence needs to know of the others.
    """

    @F.arrow_udf(_KIND)
    def parsed(sentences: pa.Array) -> pa.Array:
        return pa.array([annotate(s or "") for s in sentences.to_pylist()], _ARROW)

    rows = sent.withColumn("_t", parsed.asNondeterministic()(F.col("sentence"))).select("doc_id", "sentence_index", F.explode("_t").alias("t"))
    base = F.col("sentence_index").cast("long") * 1_000_000
    return rows.select(
        "doc_id", F.col("sentence_index").cast("int").alias("sentence_index"), (base + F.col("t.index")).alias("index"), "t.text", "t.lemma", "t.pos", "t.dep", (base + F.col("t.head")).alias("head"), "t.start"
    )
