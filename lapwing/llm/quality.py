"""Line-first quality rules.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines
are taken out, and a document is rejected when what is left is too little of it.
One pass over the rows, no shuffle, nothing kept between rows.

Defined results for odd input: a null text counts as empty and is rejected (no words);
a null or repeated doc_id is carried through, row by row; further columns of the input
are ignored by ``quality_report`` and kept, in order, by ``clean_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture, in lower case, by language; a line that holds one is boilerplate.
BOILERPLATE = {
    "en": (
        "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
        "uses cookies", "use of cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
        "subscribe to our newsletter", "powered by",
    ),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "impressum", "newsletter abonnieren"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "mentions légales"),
    "es": ("todos los derechos reservados", "política de privacidad", "condiciones de uso", "utiliza cookies", "aviso legal"),
}
#: Short lines made of these words alone are navigation; by language.
NAVIGATION = {
    "en": (
        "home", "login", "log in", "sign in", "sign up", "register", "next", "previous", "prev", "back to top",
        "read more", "click here", "menu", "search", "contact us", "about us", "skip to content", "share this",
    ),
    "de": ("startseite", "anmelden", "registrieren", "weiter", "zurück", "nach oben", "mehr lesen", "suche", "kontakt", "über uns"),
    "fr": ("accueil", "connexion", "s'inscrire", "suivant", "précédent", "haut de page", "lire la suite", "recherche", "contactez-nous"),
    "es": ("inicio", "iniciar sesión", "registrarse", "siguiente", "anterior", "volver arriba", "leer más", "buscar", "contacto"),
}
REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_bad_lines long, n_kept_words long"
)

_every = lambda phrases: "|".join(re.escape(p) for some in phrases.values() for p in some)
_boiler = re.compile(_every(BOILERPLATE))
_navigation = re.compile(r"[\s|>/·•»›-]*(?:(?:" + _every(NAVIGATION) + r")[\s|>/·•»›.-]*)+")
_separator = re.compile(r"(?:^|\s)[|»›>·•](?=\s|$)")
_shout = re.compile(r"[!?]{2,}(?=\s|$)")
_sentence = re.compile(r"[.!?…:;。！？]")
_stop = re.compile(r"(?<=[.!?…。！？])\s+")
_symbol = re.compile(r"[#*$%&|<>{}\[\]\\~^=_@+]")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; all are shares of the line's own size."""

    symbol_share: float = 0.25  #: symbols per word from which a line is not prose
    shout_share: float = 0.3  #: words ending in !! or ??, per word
    separator_share: float = 0.15  #: free-standing menu separators per word
    flat_words: int = 30  #: a longer line without one sentence mark is not prose
    kept_share: float = 0.5  #: share of words that must survive
    least_words: int = 10  #: words that must survive

    def line_fails(self, line: str, n_words: int) -> str | None:
        """Name of the first rule that a line of ``n_words`` words fails."""
        if n_words >= self.flat_words and not _sentence.search(line):
            return "punctuation"
        if (n := len(_symbol.findall(line))) >= 3 and n > self.symbol_share * n_words:
            return "navigation" if len(_separator.findall(line)) >= max(2, self.separator_share * n_words) else "punctuation"
        if len(_shout.findall(line)) > self.shout_share * n_words:
            return "punctuation"
        if len(_separator.findall(line)) >= max(2, self.separator_share * n_words):
            return "navigation"
        low = line.lower()
        if n_words <= 12 and _navigation.fullmatch(low.strip()):
            return "navigation"
        return "boilerplate" if _boiler.search(low) and self._mostly_boilerplate(low) else None

    def _mostly_boilerplate(self, low: str) -> bool:
        """Whether the sentences that hold a phrase are half of a line's words: one phrase in a long line is no reason to drop it."""
        sizes = [(len(s.split()), bool(_boiler.search(s))) for s in _stop.split(low)]
        return 2 * sum(n for n, bad in sizes if bad) >= sum(n for n, _ in sizes)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside ``width``-word windows that stand twice or more in the text, the first included."""
    if len(words) <= width:
        return 0
    # Words as numbers, and each window as a number of its own by pairing neighbours: a few integers per word at most.
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) == len(words):
        return 0
    windows, span = ids, 1
    while span < width:
        step = min(span, width - span)
        _, windows = np.unique(windows[:-step] * np.int64(len(words)) + windows[step:], return_inverse=True)
        span += step
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(times[which] > 1)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def judge(text: bytes | None, rules: LineRules) -> tuple[tuple, list[bytes]]:
    """The report columns after doc_id for one whole text (UTF-8 bytes), and the lines that stay."""
    text = text or b""
    words = text.split()
    repeats = repeated_words(words)
    n_lines = n_bad = n_dup = left = 0
    seen: set[bytes] = set()
    stay = []
    for line in text.split(b"\n"):
        if not (n := len(line.split())):
            stay.append(line)
            continue
        n_lines += 1
        n_dup += line in seen
        seen.add(line)
        if rules.line_fails(line.decode("utf-8", "replace"), n):
            n_bad += 1
        else:
            left += n
            stay.append(line)
    n = len(words)
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUING)))
    base = n < 10 or 100 * repeats > 20 * n
    kept = not base and left >= rules.least_words and left >= rules.kept_share * n
    return (n, chars, sum(map(text.count, _SYMBOLS)), n_dup, repeats, base, kept, n_lines, n_bad, left), stay


#: UTF-8 continuation bytes: bytes that are not code points of their own.
_CONTINUING = bytes(range(0x80, 0xC0))
_SYMBOLS = [bytes([c]) for c in SYMBOLS]


def _reports(batches: Iterator[pa.RecordBatch], rules: LineRules) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in REPORT.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [judge(t, rules)[0] for t in part.column("text").cast(pa.binary()).to_pylist()]
            columns = [part.column("doc_id").cast(pa.int64())]
            for k, values in enumerate(zip(*rows)):
                columns.append(pa.array(values, pa.bool_() if names[k + 1] in ("base_failed", "kept") else pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ``base_failed`` and the verdict ``kept``."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _reports(batches, rules), REPORT)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Kept documents, all columns, with failing lines taken out of ``text`` (``n_chars``, where present, is renewed)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            judged = [judge(t, rules) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            texts = pa.array([b"\n".join(stay) for _, stay in judged], pa.binary()).cast(batch.schema.field(at).type)
            columns = [texts if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([x[6] for x, _ in judged], pa.bool_()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
