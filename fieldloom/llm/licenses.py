"""License scans by ordered signature rules.

The words of a text (A-Z lowered, everything else than 0-9, a-z and non-ASCII
characters separating) are joined by one space, and regular expressions over
that line find license statements. Two tables make the rules: signatures (the
sentences of license texts, grants, headers, notices and addresses, each an
expression of its own), and license names, each in a few phrase forms. Every
rule has a priority and is gated by keywords: one pass of an automaton finds
the keywords that stand in the line, and only rules whose keywords do are
tried. Overlaps are resolved by priority: a detection whose interval of words
lies within that of an accepted detection of higher priority (or of equal
priority and an earlier rule) is dropped.

Defined results: a null text counts as empty; an empty text has no words, no
labels ("") and score 0; repeated rows each give a result; an empty table gives
an empty result; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.common import map_arrow, narrow, record, slices
from fieldloom.llm.license_signatures import SIGNATURES

#: Phrases whose places are counted, with their labels (fixed by contract).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> names as they read once the words are joined by one space.
NAMES: dict[str, str] = {
    "afl": r"academic free license", "agpl": r"(?:gnu )?affero general public licen[sc]e|(?:gnu )?agpl(?:v[13])?",
    "apache": r"apache (?:software )?licen[sc]e|apache 2 0|asl 2 0", "apsl": r"apple public source license",
    "artistic": r"(?:perl )?artistic licen[sc]e", "blueoak": r"blue oak model license",
    "bsd": r"(?:new |modified |simplified )?bsd (?:[0-4] clause )?licen[sc]e|bsd [0-4] clause|0bsd", "bsl": r"boost software license",
    "busl": r"business source license|busl 1 1", "cc-by": r"cc by(?! (?:nc|nd|sa))|creative commons attribution(?! (?:non|no|share))",
    "cc-by-nc": r"cc by nc(?! (?:nd|sa))|creative commons attribution non ?commercial(?! (?:no|share))", "cc-by-nc-nd": r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?",
    "cc-by-nc-sa": r"cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc-by-nd": r"cc by nd|creative commons attribution no ?deriv(?:ative)?s?",
    "cc-by-sa": r"cc by sa|creative commons attribution share ?alike", "cc0": r"cc0|creative commons zero",
    "cddl": r"common development and distribution license|cddl", "cecill": r"cecill(?: [abc])?", "cpl": r"common public license",
    "ecl": r"educational community license", "epl": r"eclipse public license|epl [12] 0", "eupl": r"european union public licen[sc]e|eupl",
    "fdl": r"(?:gnu )?free documentation license|gfdl", "gpl": r"(?:gnu )?(?<!affero )(?<!lesser )(?<!library )general public licen[sc]e|(?:gnu )?gpl(?:v[123])?",
    "isc": r"isc license", "json": r"json license", "lgpl": r"(?:gnu )?(?:lesser|library) general public licen[sc]e|(?:gnu )?lgpl(?:v[23])?",
    "lppl": r"latex project public license", "mit": r"mit licen[sc]e|expat license|x11 license", "mit-0": r"mit no attribution",
    "mpl": r"mozilla public license|mpl [12] [01]", "mspl": r"microsoft public license|ms pl", "msrl": r"microsoft reciprocal license|ms rl",
    "mulan": r"mulan (?:permissive|public) (?:software )?license", "ncsa": r"ncsa (?:open source )?license", "odbl": r"open database license|odbl",
    "odc-by": r"open data commons attribution license", "ofl": r"(?:sil )?open font license", "openssl": r"openssl license",
    "osl": r"open software license", "php": r"php license", "postgresql": r"postgresql license", "psf": r"python software foundation license|psf license",
    "public-domain": r"public domain", "qpl": r"q public license", "ruby": r"ruby license", "sspl": r"server side public license|sspl",
    "unlicense": r"unlicense", "upl": r"universal permissive license", "vim": r"vim license", "w3c": r"w3c (?:software )?(?:notice and )?license",
    "wtfpl": r"do what the fuck you want to public license|wtfpl", "zlib": r"zlib license", "zpl": r"zope public license",
}
#: Names that are too short to stand alone; they count in forms that say what they are.
SHORT = {"mit": r"mit", "bsd": r"bsd", "apache": r"apache(?: 2 0)?", "isc": r"isc", "zlib": r"zlib", "artistic": r"artistic(?: [12] 0)?", "psf": r"psf"}
VERSION = r"(?: v(?:ersion)? ?\d+(?: \d+)*| \d+(?: \d+)+)?(?: only| or (?:any )?later(?: version)?)?"
#: form -> (keyword that must stand in the line or "", expression around the name, priority, whether short names count).
FORMS: dict[str, tuple[str, str, int, bool]] = {
    "tag": ("spdx", r"spdx licen[sc]e identifier (?:{name}){version}", 6, True),
    "listed": ("spdx org", r"spdx org licenses (?:{name}){version}", 4, True),
    "licensed": ("licensed", r"(?:is |are |dual )?licensed under (?:the )?(?:terms of (?:the )?)?(?:{name}){version}", 3, True),
    "field": ("licen", r"licen[sc]e (?:is )?(?:{name}){version}", 3, True),
    "released": ("under", r"(?:released|distributed|published|available|provided|covered) under (?:the )?(?:terms of (?:the )?)?(?:{name}){version}", 3, True),
    "dedicated": ("", r"(?:dedicated|placed|subject|pursuant) (?:to|in|under) (?:the )?(?:{name}){version}", 2, False),
    "named": ("", r"(?:{name}){version}", 1, False),
}
CONFIDENCE = {6: 0.99, 5: 0.95, 4: 0.9, 3: 0.9, 2: 0.7, 1: 0.5, 0: 0.6}
WORD = r"0-9a-z\x80-\xff"

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Rule:
    """``all_of`` and one of ``any_of`` must stand in the line for the expression to be tried."""

    label: str
    all_of: tuple[str, ...]
    any_of: tuple[str, ...]
    expression: re.Pattern[bytes]
    priority: int


def keyword_of(alternative: str) -> str:
    """A word that every match of the alternative holds: its longest run of plain letters."""
    bare = re.sub(r"\((?:\?[:!<=]+)[^()]*\)\??", "|", re.sub(r"\(\?<?[!=][^()]*\)", "|", alternative))
    runs = re.findall(r"[0-9a-z ]+(?!\?)", re.sub(r".\?|\[[^]]*\]", "|", bare))
    return max((r.strip() for r in runs), key=len)


def split_names(names: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(names + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(names[start:i])
            start = i + 1
    return out


def whole_words(expression: str) -> re.Pattern[bytes]:
    return re.compile(rf"(?<![{WORD}])(?:{expression})(?![{WORD}])".encode("latin-1"))


def signature_rules(table: str = SIGNATURES) -> list[Rule]:
    """A rule for each line of the table of signatures."""
    rules = []
    for line in table.strip().splitlines():
        label, priority, text = line.split(" ", 2)
        plain = re.sub(r" ~\d+", "|", re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??", "|", text))
        plain = re.sub(r".\[[^]]*\]|\[[^]]*\]|.\?", "|", plain)
        keyword = max((x.strip() for x in plain.split("|")), key=len)
        gaps = re.sub(r" ~(\d+)", lambda m: f"(?: [{WORD}]+){{0,{m[1]}}}?", text)
        rules.append(Rule(label, (keyword,), (), whole_words(gaps), int(priority)))
    return rules


def named_rules(names: dict[str, str] | None = None, forms: dict[str, tuple[str, str, int, bool]] | None = None) -> list[Rule]:
    """Every form of every license name."""
    rules = []
    for keyword, form, priority, short in (forms or FORMS).values():
        for label, name in (names or NAMES).items():
            name = f"{name}|{SHORT[label]}" if short and label in SHORT else name
            words = tuple(keyword_of(x) for x in split_names(name))
            text = form.replace("{name}", name).replace("{version}", VERSION)
            rules.append(Rule(label, (keyword,) if keyword else (), words, whole_words(text), priority))
    return rules


@dataclass
class RuleSet:
    """Rules by priority, with the automaton over all of their keywords."""

    rules: list[Rule]

    def __post_init__(self) -> None:
        self.rules = sorted(self.rules, key=lambda r: -r.priority)
        self.keywords = ahocorasick.Automaton()
        for r in self.rules:
            for k in (*r.all_of, *r.any_of):
                self.keywords.add_word(k, k)
        self.keywords.make_automaton()

    def tried(self, line: bytes) -> list[tuple[int, Rule]]:
        there = {k for _, k in self.keywords.iter(line.decode("latin-1"))}
        if not there:
            return []
        return [(i, r) for i, r in enumerate(self.rules) if there.issuperset(r.all_of) and (not r.any_of or not there.isdisjoint(r.any_of))]


@cache
def rules_here() -> RuleSet:
    return RuleSet([*signature_rules(), *named_rules()])


def line_of(text: str) -> tuple[bytes, int]:
    words = text.encode().translate(_TABLE).split()
    return b" ".join(words), len(words)


def places(line: bytes, phrase: bytes) -> list[int]:
    """Offsets in the line at which the phrase's words stand."""
    if phrase not in line:
        return []
    padded, out, at = b" " + line + b" ", [], -1
    wanted = b" " + phrase + b" "
    while (at := padded.find(wanted, at + 1)) >= 0:
        out.append(at)
    return out


def detect(line: bytes, rules: RuleSet) -> list[tuple[int, int, str, int]]:
    """Accepted detections: start and end offset in the line, label, priority."""
    hits = []
    for order, r in rules.tried(line):
        hits += [(-r.priority, order, m.start(), m.end(), r.label) for m in r.expression.finditer(line)]
    accepted: list[tuple[int, int, str, int]] = []
    reach: list[tuple[int, int]] = []  # starts of accepted detections with the farthest end so far, ascending in both
    for p, _, a, b, label in sorted(hits):
        i = bisect_right(reach, (a, 1 << 62)) - 1
        if i >= 0 and reach[i][1] >= b:
            continue
        accepted.append((a, b, label, -p))
        lo = i + 1
        hi = lo
        while hi < len(reach) and reach[hi][1] <= b:
            hi += 1
        if i >= 0 and reach[i][0] == a:
            lo = i
        reach[lo:hi] = [(a, b)]
    return sorted(accepted)


def scan_text(text: str, rules: RuleSet) -> tuple[int, int, int | None, int | None, str, str, float, list]:
    line, n = line_of(text)
    found = [(at, label) for phrase, label in BASE.items() for at in places(line, phrase.encode())]
    more = detect(line, rules)
    if not found and not more:
        return n, 0, None, None, "", "", 0.0, []
    # The word at an offset is the number of spaces before it: one pass over the line for all offsets.
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    word_at = lambda offsets: np.searchsorted(spaces, np.array(offsets, dtype=np.int64)).tolist()
    starts = word_at([at for at, _ in found])
    base = sorted({label for _, label in found})
    doubt = 1.0
    for p in [m[3] for m in more] + ([0] if found and not more else []):
        doubt *= 1 - CONFIDENCE[p]
    spans = [{"label": m[2], "first": a, "last": b} for m, a, b in zip(more, word_at([m[0] for m in more]), word_at([m[1] for m in more]), strict=True)]
    labels = ",".join(sorted({*base, *(m[2] for m in more)}))
    return n, len(found), min(starts, default=None), max(starts, default=None), ",".join(base), labels, 1 - doubt, spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, places, labels, score, and detections (label, first and last word)."""
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", spans)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = rules_here()
        for part in slices(batches):
            rows = [scan_text(t or "", rules) for t in part.column(1).to_pylist()]
            yield record(schema, part.column(0), *zip(*rows, strict=True))

    return map_arrow(narrow(docs, id_col, text_col).toDF("doc_id", "text"), kernel, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first:int,last:int>>")
