"""Operator 1: personal data by a skip-chain conditional random field.

Tokens are labelled O, EMAIL, PHONE, IP, CARD, SECRET or NAME. The model has
unary potentials from features of a token and its neighbours, chain potentials
between neighbours, and skip potentials between distant tokens of a document
that are equal or similar (``link``: the same but for case, surrounding marks, a
possessive ending, a key in front of a value, or the marks within a long number).
Each mention is linked with the first one. Loopy belief
propagation passes messages along chain and skip edges, so a mention with clear
context settles the label of its repetitions.

Most words can't be part of an entity: the label domain of a token without
digit, at sign or other cue is {O} alone. A cue is also a key word (``password``) or
a title up to two tokens before, or a call for a name (``contact``) before capitalised
words. A token without one is observed, which cuts the chain there exactly; only
runs of open tokens need messages, and a document without an open token is passed
through in the JVM.

The weights are learned here, by maximum pseudo-likelihood on generated documents
with known labels (``train``): unary, chain and skip weights together, the last
from the linked mentions of these documents.

Defined cases
-------------
* A null text stays null with no entities; an empty one stays empty.
* Null ids, languages and sources are carried through. Repeated rows are
  labelled alike, each on its own.
* Long texts are labelled whole. All mentions of a token take part, at full strength; the
  cost is linear in their number.
* An empty table gives an empty result. Extra columns are carried through by ``redact``.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import fresh

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "NAME")
K = len(LABELS)
HASH_SIZE = 1 << 15
ROUNDS = 6
TRAIN_DOCUMENTS = 6000
STEPS = 150
THRESHOLD = 0.5

_TOKEN = re.compile(r"\S+")
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Señor|Señora)\.?"
#: A document with none of these has only O tokens.
CUES = r"[0-9@]|(?i:token|secret|passw|pwd|apikey|api[_-]key|key=|bearer)|[A-Z0-9]{20}|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Señor|Señora)\b|\b(?i:contact|dear|regards|signed|attn|sincerely)\b"
_OPEN = re.compile(r"[0-9@]|(?i:token|secret|passw|pwd|apikey|api[_-]key|key=|bearer)|[A-Z0-9]{20}")
_HAS_TITLE = re.compile(r"\b" + _TITLE + r"(?=\s)")
_CAPITAL = re.compile(r"[^\w]*[A-ZÀ-ÖØ-Þ][\w'’-]+")
_EDGE = "\"'.,;:!?()[]{}<>%&#$*|=`~"
#: Marks that may stick to the end of any token.
_MARKS = ",.!#%&$*;)"
_NAME_CALL = {"contact", "dear", "regards", "signed", "attn", "sincerely"}
#: A key word with its sign, as one token or two.
_KEY_SIGN = re.compile(r"(?i)[\"']?(?:[\w-]*(?:token|secret|password|passwd|pwd|api[_-]?key|bearer))[\"']?\s*[:=]?")
_KEYWORD = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|key|bearer)\W*$")
_CUE_WORDS = {"phone", "tel", "call", "mobile", "fax", "email", "mail", "contact", "ip", "host", "server", "card", "visa", "account", "version", "page", "chapter", "year", "room", "price", "order", "item", "cost", "no", "nr", "section", "figure", "table", "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme"}


def bare(token: str) -> str:
    """Without surrounding marks, case folded."""
    return token.strip(_EDGE).lower()


def link(token: str) -> str:
    """The form that equal and similar mentions share; "" for one that links nothing."""
    t = bare(token)
    if (m := re.fullmatch(r"[\w-]+[=:]\W*(\S{6,})", t)) and not t[0].isdigit():
        t = m[1].strip(_EDGE)
    t = re.sub(r"['’]s$", "", t)
    digits = re.sub(r"[^0-9]", "", t)
    if len(digits) >= 7 and re.fullmatch(r"[0-9+()./\s-]+", t):
        return digits
    return t if len(t) > 1 else ""


def shape(token: str) -> str:
    s = re.sub(r"[0-9a-f]{16,}", "H", token) if re.search(r"[0-9a-f]{16,}", token) else token
    out = []
    for c in s:
        k = "d" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
        if not out or out[-1][0] != k or k not in "daA":
            out.append([k, 1])
        else:
            out[-1][1] += 1
    return "".join(k + (str(min(n, 4)) if k == "d" else "") for k, n in out)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def token_features(tokens: list[str], i: int, linked: bool = False) -> list[str]:
    """Feature names of token ``i``; of distant tokens no more enters than whether one is ``linked``."""
    t = tokens[i]
    core = t.strip(_EDGE)
    prev, nxt = (tokens[i - 1] if i else ""), (tokens[i + 1] if i + 1 < len(tokens) else "")
    digits = re.sub(r"\D", "", core)
    out = ["bias", "sh=" + shape(core), "psh=" + shape(prev.strip(_EDGE)), "nsh=" + shape(nxt.strip(_EDGE)), f"nd={min(len(digits), 20)}"]
    p = bare(prev)
    if p in _CUE_WORDS:
        out.append("pw=" + p)
    if i > 1 and (q := bare(tokens[i - 2])) in _CUE_WORDS:
        out.append("pw2=" + q)
    if re.fullmatch(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", core):
        out.append("email")
    if (m := re.fullmatch(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?:[:/]\d+)?", core)) and all(int(x) < 256 for x in m.groups()):
        out.append("quad")
    if re.fullmatch(r"\d(?:[ -]?\d){12,18}", core):
        out.append("cardlike")
        out.append("luhn" if _luhn(digits) else "noluhn")
    if re.fullmatch(r"\d{4}", core):
        out.append("four")
    if t.startswith(("+", "(+", "00")):
        out.append("plus")
    if re.fullmatch(r"\(\d{2,5}\)\S*", t.lstrip("\"'")):
        out.append("area")
    if re.fullmatch(r"\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{6,12}", core):
        out.append("phonelike")
    if len(core) >= 16 and re.fullmatch(r"[A-Za-z0-9_+/=-]+", core) and digits and len(digits) < len(core):
        out.append("randomlike")
    if re.fullmatch(r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}|(?:gh[pousr]_|sk-|xox[bp]-|glpat-|AIza)\w[\w-]{15,}|eyJ[\w-]+\.[\w-]+\.[\w-]+", core):
        out.append("keyform")
    left = " ".join(tokens[max(0, i - 2) : i])
    if _KEYWORD.search(left) or re.match(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|bearer)\W*[=:]\W*\S{6,}", t):
        out.append("after_key")
    if re.search(_TITLE + r"$", prev) or (i > 1 and re.search(_TITLE + r"$", tokens[i - 2]) and prev[:1].isupper()):
        out.append("after_title")
    if core[:1].isupper() and not digits:
        out.append("capital")
        out.append("starts" if not prev or prev[-1:] in ".!?:" and not re.search(_TITLE + r"$", prev) else "inside")
    if linked:
        out.append("lk=" + shape(core))
    if _called(tokens, i):
        out.append("called")
    if _KEY_SIGN.fullmatch(t.rstrip(_MARKS)):
        out.append("key")
    if re.match(r"[€$£]", t) or nxt[:3].lower() in ("usd", "eur", "kg", "km", "cm", "doc", "%"):
        out.append("amount")
    return out


def _index(names: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(x.encode()) % HASH_SIZE for x in names), np.int64, len(names))


def _called(tokens: list[str], i: int) -> bool:
    """Whether a run of capitalised words up to ``i`` follows a call for a name."""
    k = i
    while k >= 0 and i - k < 4 and _CAPITAL.match(tokens[k]) and bare(tokens[k]) not in _NAME_CALL:
        k -= 1
    return k < i and k >= 0 and bare(tokens[k]) in _NAME_CALL


def _values(tokens: list[str], i: int) -> list[int]:
    """The places of the value of the key word at ``i``: behind its sign, or behind a sign that stands alone."""
    t, nxt = tokens[i].rstrip(_MARKS), (tokens[i + 1].rstrip(_MARKS) if i + 1 < len(tokens) else "")
    if not _KEY_SIGN.fullmatch(t):
        return []
    if t[-1:] in "=:":
        return [i + 1] if nxt else []
    return [i + 2] if nxt in ("=", ":", "is") and i + 2 < len(tokens) else []


def open_tokens(tokens: list[str], titled: bool) -> np.ndarray:
    """Which tokens may have a label other than O."""
    out = np.zeros(len(tokens), bool)
    called = any(x in t.lower() for t in tokens for x in _NAME_CALL)
    # what else is open wherever it is mentioned
    values, names = set(), set()
    for i, t in enumerate(tokens):
        if _OPEN.search(t):
            out[i] = True
            for k in _values(tokens, i):
                out[k] = True
                values.add(link(tokens[k]))
        elif _CAPITAL.match(t) and not re.fullmatch(_TITLE, t):
            if titled:
                out[i] = True
            elif called and _called(tokens, i):
                out[i] = True
                names.add(link(t))
    values.discard("")
    names.discard("")
    if values or names:
        for i in np.flatnonzero(~out).tolist():
            form = link(tokens[i])
            out[i] = form in values or form in names and _CAPITAL.match(tokens[i]) is not None
    return out


def links(forms: list[str]) -> np.ndarray:
    """For each token the place of the first mention of its form among ``forms``, or -1 for that one."""
    first: dict[str, int] = {}
    return np.array([-1 if not f or first.setdefault(f, i) == i else first[f] for i, f in enumerate(forms)], np.int64)


def features(tokens: list[str], pos: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
    """(hashed features, forms that link) of the open tokens at ``pos``."""
    forms = [link(tokens[i]) for i in pos]
    prev = links(forms)
    linked = prev >= 0
    linked[prev[linked]] = True
    return [_index(token_features(tokens, int(i), bool(k))) for i, k in zip(pos, linked, strict=True)], forms


# ---------------------------------------------------------------- training
def _sentence(rng: random.Random) -> tuple[list[str], list[str]]:
    syl = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

    def word() -> str:
        return "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))

    def num(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def hexa(n: int) -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    toks: list[str] = []
    labs: list[str] = []

    def caps(n: int) -> str:
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))

    def put(text: str, label: str = "O") -> None:
        for t in text.split():
            toks.append(t)
            labs.append(label)

    def plain(n: int) -> None:
        # the first follows what may be a name
        for i in range(n):
            put(word().capitalize() if i and rng.random() < 0.05 else word())

    put(word().capitalize())
    plain(rng.randint(1, 8))
    for _ in range(rng.randint(1, 3)):
        kind = rng.randrange(18)
        if kind == 0:
            if rng.random() < 0.4:
                put(rng.choice(["email", "mail", "contact"]))
            put(word() + rng.choice([".", "_", ""]) + num(rng.randint(0, 3)) + "@" + word() + num(rng.randint(0, 1)) + "." + rng.choice(["example.com", "com", "org", "co.uk"]), "EMAIL")
        elif kind == 1:
            if rng.random() < 0.4:
                put(rng.choice(["phone", "tel", "call", "mobile", "fax"]))
            put(rng.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"+{num(11)}"]), "PHONE")
        elif kind == 2:
            if rng.random() < 0.3:
                put(rng.choice(["ip", "host", "server"]))
            put(".".join(str(rng.randrange(rng.choice([256, 256, 30]))) for _ in range(4)), "IP")
        elif kind == 3:
            if rng.random() < 0.3:
                put(rng.choice(["card", "visa", "account"]))
            put(rng.choice(["4", "5", "2", "3"]) + num(15), "CARD")
        elif kind == 4:
            put(rng.choice(["card", "visa"]))
            put(" ".join(num(4) for _ in range(4)), "CARD")
        elif kind == 5:
            key, sep = rng.choice(["token", "secret", "password", "api_key", "key"]), rng.choice([" = ", ": ", " : ", "="])
            body = rng.choice([hexa(rng.choice([32, 40, 64])), word() + num(4) + word(), hexa(20)])
            mark = rng.choice(['"', "", "'"])
            if sep == "=":
                put(f"{key}={mark}{body}{mark}", "SECRET")
            else:
                put(key + sep)
                put(mark + body + mark, "SECRET")
        elif kind == 6:
            put(rng.choice(["Mr.", "Mrs.", "Dr.", "Ms.", "Prof."]))
            put(word().capitalize() + (" " + word().capitalize() if rng.random() < 0.4 else ""), "NAME")
        elif kind == 7:
            put(rng.choice(["version", "section", "figure"]))
            put(rng.choice([f"{rng.randrange(9)}.{rng.randrange(9)}", f"{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(30)}", num(1)]))
        elif kind == 8:
            put(rng.choice([str(rng.randint(1900, 2030)), num(2), num(3), f"{num(1)},{num(3)}", f"{num(2)}%", f"${num(2)}.{num(2)}"]))
        elif kind == 9:
            put(f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}")
        elif kind == 10:
            put(rng.choice(["page", "chapter", "room", "order", "item", "no"]))
            put(num(rng.randint(1, 6)))
        elif kind == 11:
            put(rng.choice([word() + num(1), f"/{word()}/{num(4)}", f"{num(2)}:{num(2)}", f"{num(1)}st", word().upper() + "-" + num(2), num(rng.randint(5, 8)), f"(v{num(1)}.{num(1)})"]))
        elif kind == 12:
            put(rng.choice(["AKIA" + caps(16), "ASIA" + caps(16), "ghp_" + hexa(36), "sk-" + hexa(32), "xoxb-" + num(11) + "-" + hexa(20)]), "SECRET")
        elif kind == 13:
            put("".join(word() for _ in range(8)).upper())
        elif kind == 14:
            put(rng.choice(["password:", "secret =", "pwd:", "password is", "token:", "passwd ="]))
            put("-".join(word() + word() for _ in range(rng.randint(1, 3))), "SECRET")
        elif kind == 15:
            put(rng.choice(["contact", "Contact", "signed", "attn", "Dear", "regards", "sincerely"]))
            put(" ".join(word().capitalize() for _ in range(rng.randint(1, 3))), "NAME")
        elif kind == 16:
            put(rng.choice(["the password was", "a secret of", "the token and", "keyword", "contact with the", "signed by the", "token" + rng.choice(["", ".", ","])]))
            put(word() + " " + word())
        else:
            put(word() + ". " + word().capitalize() + " " + word())
        plain(rng.randint(1, 5))
    return _marked(rng, toks), labs


def _marked(rng: random.Random, toks: list[str]) -> list[str]:
    """Marks of all sorts stick to tokens."""
    return [t + rng.choice([",", ".", "!!", "###", "%%%", "&&&", "$$$", "***", ";", ")"]) if rng.random() < 0.06 else t for t in toks]


def _document(rng: random.Random) -> tuple[list[str], list[str]]:
    """One to three sentences; some of what they mention, private or not, comes back later without its context, and at times otherwise written."""
    toks: list[str] = []
    labs: list[str] = []
    for _ in range(rng.randint(1, 3)):
        t, y = _sentence(rng)
        toks += t
        labs += y
    # one token of each run of a label, and numbers and capitals that are nothing private
    runs = [i for i, y in enumerate(labs) if y != "O" and (not i or labs[i - 1] != y) and (i + 1 == len(labs) or labs[i + 1] != y)]
    runs += [i for i, (t, y) in enumerate(zip(toks, labs, strict=True)) if y == "O" and (t[:1].isdigit() or t[:1].isupper())]
    for i in rng.sample(runs, min(len(runs), rng.randint(0, 4))):
        form = toks[i].strip(_EDGE)
        if not form:
            continue
        if labs[i] == "PHONE" and rng.random() < 0.4:
            form = re.sub(r"\D", "", form)
        elif labs[i] == "NAME" and rng.random() < 0.3:
            form += "'s"
        elif labs[i] == "SECRET":
            form = form.split("=")[-1].strip(_EDGE) or form
        for _ in range(rng.randint(1, 3)):
            filler = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(2, 8))]
            k = rng.randint(1, len(filler))
            toks += [*filler[:k], *_marked(rng, [form]), *filler[k:]]
            labs += ["O"] * k + [labs[i]] + ["O"] * (len(filler) - k)
    return toks, labs


@lru_cache(maxsize=2)
def train(documents: int = TRAIN_DOCUMENTS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unary weights HASH_SIZE x K, chain K x K, skip K x K), from generated documents; the same on every call."""
    rng = random.Random(seed)
    rows, ys, left, right, before = [], [], [], [], []
    for _ in range(documents):
        toks, labs = _document(rng)
        pos = np.flatnonzero(open_tokens(toks, bool(_HAS_TITLE.search(" ".join(toks)))))
        y = [LABELS.index(x) for x in labs]
        ok = {int(i) for i in pos}
        found, forms = features(toks, pos)
        before += [p + len(ys) if p >= 0 else -1 for p in links(forms).tolist()]
        for i in pos.tolist():
            left.append(y[i - 1] if i - 1 in ok else 0)
            right.append(y[i + 1] if i + 1 in ok else 0)
        rows += found
        ys += [y[i] for i in pos]
    n = len(ys)
    size = np.array([len(r) for r in rows])
    feat, owner, begin = np.concatenate(rows), np.repeat(np.arange(n), size), np.cumsum(size) - size
    y, lf, rt, prev = np.array(ys), np.array(left), np.array(right), np.array(before)
    later = np.flatnonzero(prev >= 0)
    earlier = prev[later]
    unary, chain, skip = np.zeros((HASH_SIZE, K)), np.zeros((K, K)), np.zeros((K, K))
    weights = [unary, chain, skip]
    seen = [np.full(w.shape, 1e-6) for w in weights]
    target = np.eye(K)[y]
    for _ in range(STEPS):
        score = np.add.reduceat(unary[feat], begin, axis=0)
        score += chain[lf] + chain[:, rt].T
        score[later] += skip[y[earlier]]
        np.add.at(score, earlier, skip[:, y[later]].T)
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = target - p
        grad = [np.stack([np.bincount(feat, weights=err[owner, k], minlength=HASH_SIZE) for k in range(K)], axis=1), np.zeros((K, K)), np.zeros((K, K))]
        np.add.at(grad[1], lf, err)
        np.add.at(grad[1].T, rt, err)
        np.add.at(grad[2], y[earlier], err[later])
        np.add.at(grad[2].T, y[later], err[earlier])
        for w, g, q in zip(weights, grad, seen, strict=True):
            g -= 0.3 * w
            q += g**2
            w += 0.5 * g / np.sqrt(q)
    return unary, chain, skip


# ---------------------------------------------------------------- inference
def _norm(x: np.ndarray) -> np.ndarray:
    return x - np.log(np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True)) - x.max(axis=-1, keepdims=True)


def _through(x: np.ndarray, pot: np.ndarray) -> np.ndarray:
    """Log message: logsumexp over the sender's label."""
    z = x[:, :, None] + pot[None]
    m = z.max(axis=1, keepdims=True)
    return _norm((m + np.log(np.exp(z - m).sum(axis=1, keepdims=True)))[:, 0])


def infer(unary: np.ndarray, pos: np.ndarray, forms: list[str], chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of the open tokens at ``pos`` (ascending) by loopy belief propagation.

    A round passes messages along the runs of neighbours and then between the first
    and all other mentions of each form, each exact for what the other kind has said so far.
    """
    n = len(pos)
    joined = np.append(pos[1:] == pos[:-1] + 1, False)  # chain edge i -> i + 1
    # a closed neighbour is observed as O
    base = unary.copy()
    base[~np.append(False, joined[:-1])] += chain[0]
    base[~joined] += chain[:, 0]
    a = np.flatnonzero(joined)
    prev = links(forms)
    later = np.flatnonzero(prev >= 0)
    earlier = prev[later]
    fwd, bwd, ahead, back = np.zeros((4, n, K))
    belief = base
    for _ in range(rounds if len(later) else 1):
        # chain messages are exact for the runs of this round
        heard = base + ahead + back
        for run in range(n + 1):
            f2, b2 = np.zeros((n, K)), np.zeros((n, K))
            if len(a):
                f2[a + 1] = _through((heard + fwd)[a], chain)
                b2[a] = _through((heard + bwd)[a + 1], chain.T)
            change = max(np.abs(f2 - fwd).max(initial=0), np.abs(b2 - bwd).max(initial=0))
            fwd, bwd = f2, b2
            if change < 1e-6:
                break
        heard = base + fwd + bwd
        if len(later):
            said = _through(heard[later], skip.T)
            back = np.zeros((n, K))
            np.add.at(back, earlier, said)
            ahead[later] = _through(heard[earlier] + back[earlier] - said, skip)
        new = _norm(heard + ahead + back)
        change, belief = np.abs(np.exp(new) - np.exp(belief)).max(), new
        if change < 1e-4:
            break
    return np.exp(_norm(base + fwd + bwd + ahead + back))


def _model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return train()


def entities(text: str | None, model: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(start, end, label) of the entities of a text, in characters, without surrounding marks."""
    if not text:
        return []
    titled = _HAS_TITLE.search(text) is not None
    spans = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[s:e] for s, e in spans]
    pos = np.flatnonzero(open_tokens(tokens, titled))
    if not len(pos):
        return []
    unary, chain, skip = model
    found, forms = features(tokens, pos)
    p = infer(np.stack([unary[f].sum(axis=0) for f in found]), pos, forms, chain, skip)
    label = np.where(1 - p[:, 0] > threshold, p[:, 1:].argmax(axis=1) + 1, 0)
    out: list[list] = []
    last = -2
    for i, k in zip(pos.tolist(), label.tolist(), strict=True):
        if not k:
            continue
        s, e = spans[i]
        t = text[s:e]
        s += len(t) - len(t.lstrip("\"'.,;:!?[]{}<>%&#$*|=`~"))
        e -= len(t) - len(t.rstrip("\"'.,;:!?[]{}<>%&#$*|=`~"))
        if e <= s:
            continue
        # numbers are written in several tokens; other labels join only as names
        if out and i == last + 1 and out[-1][2] == LABELS[k] and LABELS[k] in ("PHONE", "CARD", "NAME"):
            out[-1][1] = e
        else:
            out.append([s, e, LABELS[k]])
        last = i
    return [tuple(x) for x in out]


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for s, e, k in found:
        parts += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*parts, text[at:]])


_ANSWER = "struct<text: string, entities: array<struct<start: int, stop: int, label: string>>>"


def _labeller(model: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float):
    kind = pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string())])))])

    def label(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            out = []
            for t in col.to_pylist():
                if t is None:
                    out.append(None)
                    continue
                found = entities(t, model, threshold)
                out.append({"text": redacted(t, found), "entities": [{"start": s, "stop": e, "label": k} for s, e, k in found]})
            yield pa.array(out, kind)

    return label


def answers(docs: DataFrame, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``column``: the redacted text and the entities; null for a null text."""
    run = F.arrow_udf(_labeller(_model(), threshold), _ANSWER, functionType=F.ArrowUDFType.SCALAR_ITER)
    text = docs["text"].cast("string")
    # texts without a cue never reach Python: the worker sees a null in their place
    asked, got = fresh(docs, "_asked"), fresh(docs, "_got")
    out = docs.withColumn(asked, F.when(F.regexp_instr(text, F.lit(CUES)) > 0, text)).withColumn(got, run(F.col(asked)))
    plain = F.struct(text.alias("text"), F.array().cast("array<struct<start: int, stop: int, label: string>>").alias("entities"))
    return out.withColumn(column, F.when(F.col(asked).isNotNull(), F.col(got)).otherwise(F.when(text.isNotNull(), plain))).drop(asked, got)


def private(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents with the private parts of ``text`` replaced by their labels, plus n_entities and entities (places in the text as it was)."""
    out = answers(docs.select("doc_id", "text", "lang", "source"), "_a", threshold)
    found = F.coalesce(F.col("_a.entities"), F.array().cast("array<struct<start: int, stop: int, label: string>>"))
    return out.select("doc_id", F.col("_a.text").alias("text"), "lang", "source", F.size(found).alias("n_entities"), found.alias("entities"))


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with private parts replaced and ``n_chars``, where there is one, brought up to date."""
    a = fresh(docs, "_a")
    out = answers(docs, a, threshold).withColumn("text", F.col(f"{a}.text"))
    if "n_chars" in docs.columns:
        same = F.size(F.coalesce(F.col(f"{a}.entities"), F.array().cast("array<struct<start: int, stop: int, label: string>>"))) == 0
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
