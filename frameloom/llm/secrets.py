"""Secret scans: base patterns, and a linear-chain conditional random field decoded by Viterbi.

Chain. Every word of a text is a node: runs of letters, digits and + / _ . -, with = behind them. The field tags
each as begin, inside or outside of a secret, whatever its length or characters. Features are hashed names: the
token's shape (length, classes of characters, share of digits, entropy, changes of case, rare consonants, prefix,
form of a UUID, date, version or number), the same once more where a keyword stands among the three words before,
the two words before and the one behind (keywords by name, others by shape), what stands between, and the file's
(share of digits, of code marks, length of lines).

Decoding. A score is a sum over single names, so each distinct token's and gap's part is summed once and a text's
scores are a few array additions. With v the most that a node gains over outside by its tag and c the most that a
step inside gains, a secret around a node gains the largest sum of v + c over a run that holds it, at most; nodes
where this stays below what entering and leaving costs are outside on every best path. Viterbi runs over what
is left, between nodes that are outside: the result is that of one Viterbi pass over all nodes.

Training maximises the conditional likelihood by forward-backward and AdaGrad on generated secrets, in made lines, in made
source code (most of which holds none) and set into passages of the corpus, and on passages as they are: PASSAGES of each of SAMPLE documents at most, those of least
hash, around base matches and at places drawn by hash. What the base patterns match is the label, once as it is and once with
its keyword replaced; passages without a match serve as outside where a first field, trained on generated secrets alone,
finds nothing either. Weights are a fixed number of floats, sent to the tasks.

Base spans stay as they are; the field adds spans (kind crf) that overlap none of them. Documents are independent:
no shuffle. Defined cases: null texts are empty and have no spans; a text of any length is scanned whole;
repeated rows give repeated results; an empty table still trains on the generated examples and gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.llm.common import need
from frameloom.llm.shingles import slices

#: The base patterns (fixed values of the contract), in their order, and what a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
#: What every match of ASSIGN holds, in small letters.
NAMES = ("passw", "secret", "token", "apikey", "api_key")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Documents of the sample, passages of each and the characters to either side, hashed names, passes, made lines, made pieces of code.
SAMPLE, PASSAGES, AROUND, BUCKETS, EPOCHS, GENERATED, CODE = 1500, 2, 70, 1 << 15, 8, 3000, 1000
#: Nouns that programs use as names, names of secrets among them.
NOUNS = "password secret token key api_key auth session user name value data index list path file buffer size node event request response config option access bearer client login".split()
#: Tokens and gaps whose scores a task remembers, nodes of a training sequence at most.
CACHE, LONGEST = 400_000, 48
B, I, O = 0, 1, 2
#: The nodes of the chain. Splitting by it gives gaps and tokens in turn.
TOKEN = re.compile(r"([\w+/.\-]+(?:={1,2}(?![\w+/.\-=]))?)")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DATE = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")
NUMBER = re.compile(r"[+-]?[\d.,/-]+")
VERSION = re.compile(r"v?\d+(?:\.\d+)+[\w-]*")
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,4}(?:/.*)?")
WORDS = re.compile(r"[A-Z]?[a-z]{1,24}(?:[-_/.][A-Z]?[a-z]{0,24})*[.\-]*")
#: Parts of an identifier: words, runs of capitals, of digits.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüåæø".encode("latin-1")
KEYWORDS = frozenset("password passwd passphrase pass pwd secret token key apikey api_key access_key secret_key client_secret api auth authorization bearer basic credential credentials private access client aws session jwt login is".split())
NAMED = re.compile(r"passw|pwd|passphrase|secret|token|api_?key|_key\b|\bkey\b|auth|bearer|credential|session|jwt")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_", "sk-", "pk_", "xox", "eyJ", "AIza", "glpat", "MII")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[Span, tuple[int, int]]]:
    """(span, secret part) of every base match that holds, by start, then kind."""
    low = text.lower()
    out = [(("assign", m.start(), m.end()), m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN] if any(x in low for x in NAMES) else []
    if "AKIA" in text:
        out += [(("access", m.start(), m.end()), m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # A run of 16 or more is a whole run of [0-9a-f]+, as both are maximal.
    out += [(("hex", m.start(), m.end()), m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Changes of case inside a token, and runs of consonants as words seldom hold them.
INNER, DOUBLE, HARD = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]"), re.compile("[A-Z]{2}"), re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}", re.I)
SWITCH = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
CLASSES = [(x, re.compile(p)) for x, p in (("d", r"\d"), ("l", "[a-z]"), ("u", "[A-Z]"), ("s", r"[+/]"), ("e", "="), ("-", "-"), (".", r"\."), ("_", "_"), ("o", r"[^\x00-\x7f]"))]
CAPITAL_HEX = re.compile("[0-9A-F]+")


def _hash(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def consonants(t: str) -> int:
    """Characters that are no vowels."""
    return len(t.lower().encode("latin-1", "replace").translate(None, VOWELS))


def plain(t: str) -> bool:
    """Whether a token (without . and - at its ends) is a word of small letters, perhaps with a capital first."""
    return t.isalpha() and (t.islower() or t[1:].islower() or len(t) == 1)


def own_names(token: str) -> tuple[list[str], list[str]]:
    """Names of what a token is in itself, and those that count behind a keyword only."""
    t = token.strip(".-") or token
    n = len(t)
    size = f"len{min(10, n // 4)}"
    rare = min(4, sum(len(x) for x in HARD.findall(t)) * 8 // n)
    if plain(t):
        vowels = int(max(0, n - consonants(t)) / n * 5)
        own = ["bias", size, "plain", f"plain{min(n, 40)}", f"plain:first{t[0].isupper()}:{size}", f"plain:rare{rare}:{size}", f"plain:vow{vowels}:{size}", f"rare{rare}:{size}"]
        return own, [f"key:{x}" for x in ("bias", "plain", f"plain:{size}", f"plain:rare{rare}:{size}", f"plain:vow{vowels}")]
    digits = sum(map(str.isdigit, t)) / n
    form = "uuid" if UUID.fullmatch(t) else "date" if DATE.match(t) else "number" if NUMBER.fullmatch(t) else "version" if VERSION.fullmatch(t) else "hex" if HEX.fullmatch(t) else "HEX" if CAPITAL_HEX.fullmatch(t) else "host" if HOST.fullmatch(t) else "word" if WORDS.fullmatch(t) else "other"
    classes = "".join(x for x, p in CLASSES if p.search(t))
    # Identifiers are made of parts that can be spoken; random characters break into parts of one or two.
    parts = PARTS.findall(t)
    mean, spoken = min(7, 2 * n // max(1, len(parts)) // 2), min(4, int((n - consonants(t)) / n * 10))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(t).values())
    inner, switch = min(9, len(INNER.findall(t))), min(9, len(SWITCH.findall(t)))
    own = [
        "bias", size, f"short{min(n, 16)}", f"case{inner}:{size}", f"rare{rare}:{form}", f"switch{min(switch, 4)}:{size}", f"ups{int(sum(map(str.isupper, t)) / n * 8)}:{min(4, n // 6)}", f"first{t[:1].isupper()}:{min(3, inner)}:{min(4, len(DOUBLE.findall(t)))}",
        f"cls{classes}", f"cls{classes}:{size}", f"dig{int(digits * 5)}:{min(4, n // 6)}", f"ent{int(entropy * 2)}:{classes}", f"form:{form}", f"form:{form}:{size}",
        f"pre:{next((p for p in PREFIXES if t.startswith(p)), '')}", f"rare{rare}:{size}",
        f"part{mean}:{size}", f"part{mean}:{classes}", f"part{mean}:vow{spoken}", f"part{mean}:rare{rare}",
    ]
    return own, [f"key:{x}" for x in ("bias", f"form:{form}", f"cls{classes}", size, f"switch{min(switch, 4)}", f"case{min(inner, 4)}", f"rare{rare}", f"dig{int(digits * 5)}", f"part{mean}")]


def neighbour(token: str) -> str:
    """A word as those beside it see it: a keyword by its name, what opens an address as such, any other by its shape."""
    low = token.lower().strip("=.-_")
    if low in KEYWORDS:
        return low
    if NAMED.search(low):
        return "named"
    if token.isalpha() and len(token) < 20:
        return "word"
    if token.startswith("//"):
        return "slashes"  # what stands behind a scheme: a user or a host
    return "num" if NUMBER.fullmatch(token) else f"long{min(4, len(token) // 12)}"


def gap_name(gap: str) -> str:
    bare = gap.strip(" \t\r\n")
    return ("n" if "\n" in gap else "s" if gap != bare else "") + (bare[:2] + bare[-1:] if len(bare) > 2 else bare)


def file_names(text: str) -> list[str]:
    n = max(1, len(text))
    return [f"f:code{min(4, int(sum(text.count(c) for c in '{};=') / n * 200))}", f"f:line{min(4, n // (text.count(chr(10)) + 1) // 40)}", f"f:digits{min(4, int(sum(text.count(d) for d in '0123456789') / n * 50))}"]


class Scores:
    """What tokens, gaps and files add to the scores of the tags under given weights; distinct ones are summed once."""

    #: Parts of a token's row: own, behind a keyword, one before, two before, one behind. And of a gap's: before, behind.
    TOKEN_PARTS, GAP_PARTS = 5, 2

    def __init__(self, model: tuple[np.ndarray, np.ndarray]) -> None:
        self.w, self.trans = model[0].astype(np.float64), model[1].astype(np.float64)
        self.forget()

    def forget(self) -> None:
        # Number 0 is what stands before the first and behind the last token: it adds nothing.
        self.tokens: dict[str, int] = {"": 0}
        self.looks: dict[tuple, int] = {}  # rows of words, which share one where all their names are the same
        self.gaps: dict[str, int] = {"": 0}
        self.token_rows = [np.zeros((self.TOKEN_PARTS, 3))]
        self.gap_rows = [self._gap("")]
        self.keys = [False]
        self.tables: tuple | None = None

    def _sum(self, names: list[str]) -> np.ndarray:
        return self.w[_hash(names)].sum(axis=0)

    def _gap(self, gap: str) -> np.ndarray:
        name = gap_name(gap)
        return np.array([self._sum([f"gb:{name}"]), self._sum([f"ga:{name}"])])

    def learn(self, tokens: set[str], gaps: set[str]) -> None:
        tokens, gaps = tokens.difference(self.tokens), gaps.difference(self.gaps)
        if len(self.tokens) + len(tokens) + len(self.gaps) + len(gaps) > CACHE and len(self.tokens) > 1:
            raise MemoryError
        for t in tokens:
            beside = neighbour(t)
            bare = t.strip(".-")
            if plain(bare):
                look = (len(bare), bare[0].isupper(), consonants(bare), sum(map(len, HARD.findall(bare))), beside)
                known = self.looks.get(look)
                if known is not None:
                    self.tokens[t] = known
                    continue
                self.looks[look] = len(self.token_rows)
            own, key = own_names(t)
            self.tokens[t] = len(self.token_rows)
            self.token_rows.append(np.array([self._sum(own), self._sum(key), *(self._sum([f"{p}:{beside}"]) for p in ("p1", "p2", "n1"))]))
            self.keys.append(beside in KEYWORDS and beside != "is" or beside == "named")
        for g in gaps:
            self.gaps[g] = len(self.gap_rows)
            self.gap_rows.append(self._gap(g))
        if tokens or gaps or self.tables is None:
            self.tables = np.array(self.token_rows), np.array(self.gap_rows), np.array(self.keys)

    def of(self, split: list[list[str]], texts: list[str]) -> np.ndarray:
        """Scores of the tags of all nodes of several texts; each text ends with a node that is none, always outside."""
        tokens, gaps = set(chain.from_iterable(p[1::2] for p in split)), set(chain.from_iterable(p[::2] for p in split))
        try:
            self.learn(tokens, gaps)
        except MemoryError:
            self.forget()
            self.learn(tokens, gaps)
        token_table, gap_table, keys = self.tables
        number, gap_number = self.tokens.__getitem__, self.gaps.__getitem__
        t = np.fromiter(chain.from_iterable(chain(map(number, p[1::2]), (0,)) for p in split), np.int64)
        g = np.fromiter(chain.from_iterable(map(gap_number, p[::2]) for p in split), np.int64)  # a text has one gap more than tokens
        sizes = np.array([len(p) // 2 + 1 for p in split])
        # The nodes between texts are number 0, and at most three steps are looked back, so what is before a text is masked.
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(t)) - np.repeat(first, sizes)
        back = lambda k: np.where(place >= k, np.append(np.zeros(k, np.int64), t[:-k])[: len(t)], 0)
        one, two, three = back(1), back(2), back(3)
        keyed = keys[one] | keys[two] | keys[three]
        file = np.array([self._sum(file_names(x)) for x in texts])
        e = token_table[t, 0] + np.where(keyed[:, None], token_table[t, 1], 0) + token_table[one, 2] + token_table[two, 3] + token_table[np.append(t[1:], 0), 4]
        e += gap_table[g, 0] + gap_table[np.append(g[1:], 0), 1] + np.repeat(file, sizes, axis=0)
        e[first + sizes - 1] = (-1e6, -1e6, 0)
        return e


def node_names(parts: list[str], text: str) -> list[list[int]]:
    """The hashed names of every node, as training needs them; Scores adds up the same."""
    tokens, gaps = parts[1::2], parts[::2]
    file, beside = file_names(text), [neighbour(t) for t in tokens]
    keys = [b in KEYWORDS and b != "is" or b == "named" for b in beside]
    out = []
    for i, t in enumerate(tokens):
        own, key = own_names(t)
        names = own + (key if any(keys[max(0, i - 3) : i]) else []) + file + [f"gb:{gap_name(gaps[i])}", f"ga:{gap_name(gaps[i + 1])}"]
        names += [f"{p}:{beside[k]}" for p, k in (("p1", i - 1), ("p2", i - 2), ("n1", i + 1)) if 0 <= k < len(tokens)]
        out.append(_hash(names))
    return out


#: Scores of transitions that no path may take: I after nothing or after O.
_NEVER = -1e9


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """The best tags of a segment; O stands before it and after it."""
    score = emit[0] + trans[O]
    if len(emit) == 1:
        return [int((score + trans[:, O]).argmax())]
    back = []
    for e in emit[1:]:
        table = score[:, None] + trans
        back.append(table.argmax(axis=0))
        score = table.max(axis=0) + e
    path = [int((score + trans[:, O]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def possible(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Which nodes of a row can be other than outside on a best path (see the module's text); never too few."""
    inside = max(trans[B, B], trans[B, I], trans[I, B], trans[I, I]) - trans[O, O]
    ends = trans[O, B] + max(trans[B, O], trans[I, O]) - 2 * trans[O, O]
    u = np.maximum(emit[:, B], emit[:, I]) - emit[:, O] + inside
    total = np.append(0, np.cumsum(u))
    behind = total[1:] - np.minimum.accumulate(total[:-1])  # the largest sum of a run that ends here
    ahead = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]  # and that begins here
    # A run of k nodes has k - 1 steps inside, two ends instead of k + 1 steps outside.
    return behind + ahead - u >= inside - ends - 1e-6


def decoded(emit: np.ndarray, trans: np.ndarray) -> list[tuple[int, int]]:
    """First and last node of each secret on the best path."""
    at = np.flatnonzero(possible(emit, trans))
    out: list[tuple[int, int]] = []
    for w in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
        for i, y in zip(w.tolist(), viterbi(emit[w], trans), strict=True):
            if y == B:
                out.append((i, i))
            elif y == I and out:
                out[-1] = (out[-1][0], i)
    return out


def crf_spans(texts: list[str], scores: Scores) -> list[list[Span]]:
    """Secrets that the field finds, of each text."""
    split = [TOKEN.split(t) for t in texts]
    out: list[list[Span]] = [[] for _ in texts]
    emit = scores.of(split, texts)
    ends = np.cumsum([len(p) // 2 + 1 for p in split])
    places: dict[int, list[int]] = {}
    for a, b in decoded(emit, scores.trans):
        k = int(np.searchsorted(ends, a, side="right"))
        if k not in places:
            places[k] = np.append(0, np.cumsum([len(x) for x in split[k]])).tolist()
        first = int(ends[k - 1]) if k else 0
        start, end = places[k][2 * (a - first) + 1], places[k][2 * (b - first) + 2]
        while start < end and texts[k][start] in ".-":
            start += 1
        while end > start and texts[k][end - 1] in ".-":
            end -= 1
        if end > start:
            out[k].append(("crf", start, end))
    return out


Example = tuple[list[list[int]], list[int]]


def examples_of(text: str, secret_parts: list[tuple[int, int]]) -> list[Example]:
    """A text's nodes as hashed names and tags, in sequences of LONGEST at most."""
    parts = TOKEN.split(text)
    names = node_names(parts, text)
    at = np.append(0, np.cumsum([len(x) for x in parts])).tolist()
    tags, last = [], None
    for i in range(len(names)):
        a, b = at[2 * i + 1], at[2 * i + 2]
        part = next((p for p in secret_parts if a < p[1] and p[0] < b), None)
        tags.append(O if part is None else I if part == last else B)
        last = part
    return [(names[k : k + LONGEST], tags[k : k + LONGEST]) for k in range(0, len(names), LONGEST)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(examples: list[Example], epochs: int = EPOCHS, rate: float = 0.25, seed: int = 3, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS x 3) and transitions (3 x 3) of the field, by forward-backward over a batch of sequences at once."""
    examples = [x for x in examples if x[1]]
    w, trans = np.zeros((BUCKETS + 1, 3)), np.zeros((3, 3))  # the last row pads
    gw, gt = np.full((BUCKETS + 1, 3), 1e-4), np.full((3, 3), 1e-4)
    ban = np.zeros((3, 3))
    ban[O, I] = _NEVER
    width = max((len(f) for x, _ in examples for f in x), default=1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for k in range(0, len(order), batch):
            some = [examples[i] for i in order[k : k + batch]]
            n = np.array([len(y) for _, y in some])
            most = int(n.max())
            feats = np.full((len(some), most, width), BUCKETS, np.int64)
            tags = np.full((len(some), most), O)
            for i, (x, y) in enumerate(some):
                tags[i, : len(y)] = y
                for j, f in enumerate(x):
                    feats[i, j, : len(f)] = f
            real = np.arange(most)[None, :] < n[:, None]
            emit = w[feats].sum(axis=2)
            emit[~real] = (_NEVER, _NEVER, 0)  # what is behind a sequence is outside
            t = trans + ban
            alpha, beta = np.empty_like(emit), np.empty_like(emit)
            alpha[:, 0] = emit[:, 0] + t[O]
            for i in range(1, most):
                alpha[:, i] = _log_sum(alpha[:, i - 1, :, None] + t, 1) + emit[:, i]
            beta[:, -1] = t[:, O]
            for i in range(most - 2, -1, -1):
                beta[:, i] = _log_sum(t + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            z = _log_sum(alpha[:, -1] + beta[:, -1], 1)
            g = -np.exp(alpha + beta - z[:, None, None])
            np.put_along_axis(g, tags[:, :, None], np.take_along_axis(g, tags[:, :, None], 2) + 1, 2)
            g[~real] = 0
            path = np.concatenate([np.full((len(some), 1), O), tags, np.full((len(some), 1), O)], axis=1)
            grad_t = np.bincount((path[:, :-1] * 3 + path[:, 1:]).ravel(), minlength=9).reshape(3, 3).astype(float)
            grad_t[O] -= np.exp(alpha[:, 0] + beta[:, 0] - z[:, None]).sum(axis=0)
            grad_t[:, O] -= np.exp(alpha[:, -1] + beta[:, -1] - z[:, None]).sum(axis=0)
            if most > 1:
                grad_t -= np.exp(alpha[:, :-1, :, None] + t + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
            at = feats[real].ravel()
            grad = np.stack([np.bincount(at, np.repeat(g[real][:, y], width), BUCKETS + 1) for y in range(3)], axis=1)
            grad[BUCKETS] = 0
            gw += grad * grad
            gt += grad_t * grad_t
            w += rate * grad / np.sqrt(gw) - 2e-5 * w
            trans += rate * grad_t / np.sqrt(gt)
    return w[:BUCKETS].astype(np.float32), (trans + ban).astype(np.float32)


LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: What stands before secrets that are named, and keywords' stead when they are taken away.
LEADS = ("password=", "passwd: ", "pwd = ", "pwd: '", "Password: ", "secret = ", "token = \"", "api_key: ", "apikey=", "client_secret = '", "Authorization: Bearer ", "bearer ", "password is ", "auth_token: ", "aws_secret_access_key = ", "session key ", "passphrase: ")
PLAINLY = ("value", "field", "entry", "item")


class Made:
    """Made-up words, secrets and what looks like them, from a seed."""

    def __init__(self, seed: int) -> None:
        self.rnd = random.Random(seed)

    def pick(self, chars: str, low: int, high: int | None = None) -> str:
        return "".join(self.rnd.choice(chars) for _ in range(self.rnd.randint(low, high or low)))

    def syllable(self) -> str:
        return self.rnd.choice("bcdfghklmnprstvw") + self.rnd.choice("aeiou") + self.rnd.choice(("", "", "n", "r", "s", "l"))

    def word(self, low: int = 1, high: int = 3) -> str:
        return "".join(self.syllable() for _ in range(self.rnd.randint(low, high)))

    def prose(self, low: int = 3, high: int = 10) -> str:
        return " ".join(self.word(1, self.rnd.choice((2, 3, 7))) + self.rnd.choice(("", "", "", ",", ".")) for _ in range(self.rnd.randint(low, high)))

    def secret(self) -> tuple[str, str]:
        """What stands before a secret, and the secret, which may be of several words."""
        pick, mixed = self.pick, LOW + UP + DIGITS
        lead = self.rnd.choice(LEADS)
        kind = self.rnd.randrange(19)
        if kind == 0:
            return "", self.rnd.choice(("AKIA", "ASIA")) + pick(UP + DIGITS, 16)
        if kind == 1:
            return lead, pick(LOW + DIGITS, 10, 24)
        if kind in (2, 3):
            return self.rnd.choice((lead, lead, "")), pick(mixed, 16, 44)
        if kind == 4:
            return self.rnd.choice((lead, "")), pick("0123456789abcdef", self.rnd.choice((32, 40, 64)))
        if kind == 5:
            return "", self.rnd.choice(("ghp_", "gho_", "sk_live_", "pk_test_", "xoxb-", "AIza", "glpat-")) + self.rnd.choice((pick(mixed, 20, 40), pick(mixed, 20, 40), pick(DIGITS, 9, 14) + "-" + pick(mixed, 16, 30), "-".join(pick(LOW + DIGITS, 6, 20) for _ in range(self.rnd.randint(2, 3)))))
        if kind == 6:
            return self.rnd.choice((lead, "")), pick(mixed + "/+", 30, 60) + self.rnd.choice(("", "=", "=="))
        if kind == 7:
            return self.rnd.choice((lead, "")), "eyJ" + pick(mixed, 20, 40) + ".eyJ" + pick(mixed, 30, 80) + "." + pick(mixed + "_-", 43)
        if kind == 8:
            size = self.rnd.choice((40, 64, 76))
            return "-----BEGIN " + self.rnd.choice(("", "RSA ", "EC ")) + "PRIVATE KEY-----\n", "\n".join(pick(mixed + "/+", size) for _ in range(self.rnd.randint(2, 6)))
        if kind in (9, 10):
            return self.rnd.choice((lead, "")), pick(LOW + UP, 14, 40)
        if kind == 11:
            return lead, pick(LOW, 16, 40)
        if kind in (12, 13):
            return lead, self.rnd.choice((self.word(2, 3), pick(LOW, 4, 8), self.word(1, 3).capitalize())) + pick(DIGITS, 1, 4) + pick(LOW, 0, 2)
        if kind == 14:
            return lead, pick(mixed, 6, 12) + self.rnd.choice(DIGITS + UP)
        if kind == 15:
            return lead, " ".join(pick(LOW + DIGITS, 4) for _ in range(self.rnd.choice((4, 6, 8))))
        user = self.rnd.choice((self.word(), self.name(), ""))
        return f"{self.scheme()}://{user}:", self.rnd.choice((self.word(1, 4), self.word(1, 3).capitalize() + pick(DIGITS, 1, 4), pick(mixed, 5, 24), pick(LOW + DIGITS, 6, 20), *(pick(mixed, 4, 8) + self.rnd.choice("!!!!$%*#-_.") + x for x in (pick(mixed, 2, 6), pick(DIGITS, 1, 4)))))

    def scheme(self) -> str:
        return self.word(1, 3) + self.rnd.choice(("", "", "s", "+" + self.word(1, 2)))

    def host(self) -> str:
        """What stands behind the user in an address."""
        word, rnd = self.word, self.rnd
        name = rnd.choice((word(), "localhost", f"{word()}.{word()}.{rnd.choice(('com', 'org', 'net', 'io'))}", f"{word()}-{rnd.randint(1, 9)}", f"{rnd.randint(1, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.{rnd.randint(1, 255)}"))
        return name + rnd.choice(("", f":{rnd.randint(80, 65535)}")) + rnd.choice(("", f"/{word()}", f"/{word()}/{self.name()}", f"/{word()}?{word()}={word()}"))

    def likeness(self) -> str:
        """What looks like a secret and is none."""
        pick, word, rnd = self.pick, self.word, self.rnd
        return rnd.choice((
            lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", lambda: f"+{pick(DIGITS, 2)} {pick(DIGITS, 3)}-{pick(DIGITS, 3)}-{pick(DIGITS, 4)}",
            lambda: pick(DIGITS, 3) + "-" + pick(DIGITS, 3) + "-" + pick(DIGITS, 4), lambda: f"{word()}.{pick(DIGITS, 2)}@{word()}.{rnd.choice(('com', 'org', 'net', 'de'))}", lambda: f"{word()}@mail{pick(DIGITS, 1)}.example.com", lambda: f"https://{word()}.example.com/{word()}/{pick(DIGITS, 6)}",
            lambda: f"https://www.{word(2, 4)}.com/{word(2, 4)}-{word()}/{word(2, 4)}", lambda: f"version-{rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 9)}", lambda: pick(DIGITS, 8, 19), lambda: " ".join(pick(DIGITS, 4) for _ in range(4)), lambda: f"{pick(UP, 2)}{pick(DIGITS, 2)} " + " ".join(pick(DIGITS, 4) for _ in range(4)),
            lambda: f"{word()}_{word()}_{rnd.randint(1, 99)}", lambda: f"{rnd.randint(1, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.{rnd.randint(1, 255)}", lambda: f"img_{pick(DIGITS, 8)}.jpeg", lambda: word(5, 11), lambda: word(5, 11).capitalize(), lambda: word(2, 5).upper(), lambda: f"{word(2, 4)}-{word(2, 4)}", lambda: f"{word()}_{word(2, 4)}_{word()}",
            lambda: "".join(word(1, 2).capitalize() for _ in range(rnd.randint(2, 4))), lambda: word() + "".join(word(1, 2).capitalize() for _ in range(rnd.randint(1, 3))), lambda: f"{word(2, 4)}.{word(1, 3)}", lambda: f"{pick(DIGITS, 1, 4)}{rnd.choice(('th', 'px', 'kg', 'ml', 'km'))}", lambda: f"{word().capitalize()}{pick(DIGITS, 1, 4)}", lambda: f"{word().upper()}-{pick(DIGITS, 2, 5)}",
            lambda: f"{rnd.choice(('the', 'a', 'my', 'every', 'this'))} {rnd.choice(('password', 'secret', 'token', 'key', 'session', 'bearer', 'auth'))} {rnd.choice(('is', 'was', 'of', 'for', 'to', 'and', 'must', word()))} {rnd.choice((word(1, 4), 'not ' + word()))}", lambda: f"{rnd.choice(('key', 'token', 'session', 'secret'))}: {word(1, 4)} {word()}",
            # Addresses without a password.
            lambda: f"{self.scheme()}://{self.host()}", lambda: f"https://{self.host()}", lambda: f"{self.scheme()}://{word()}@{self.host()}", lambda: f"mailto:{word()}@{self.host()}", lambda: f"git@{word()}.com:{word()}/{self.name()}", lambda: f"//{self.host()}", lambda: f"{word()}:{self.name()}@{self.host()}", lambda: f"@{word()}: {word()} @{self.name()}", lambda: f"{self.scheme()}://{word()}:{pick(DIGITS, 2, 5)}/{word()}@{rnd.randint(1, 9)}.{rnd.randint(0, 9)}",
        ))()

    def name(self) -> str:
        """An identifier as source code has them."""
        word, rnd = self.word, self.rnd
        some = [rnd.choice((word(1, 2), word(1, 2), word(2, 3), rnd.choice(NOUNS))) for _ in range(rnd.choice((1, 1, 2, 2, 3, 4)))]
        return rnd.choice((
            lambda: "_".join(some), lambda: "_".join(some).upper(), lambda: some[0] + "".join(x.capitalize() for x in some[1:]), lambda: "".join(x.capitalize() for x in some), lambda: "_" * rnd.randint(1, 2) + "_".join(some),
            lambda: "".join(some) + str(rnd.randint(0, 99)), lambda: some[0].upper() + "_" + "_".join(some), lambda: "".join(x[: rnd.randint(1, 4)] for x in some), lambda: "-".join(some), lambda: f"{word(1, 1)}{rnd.randint(0, 9)}", lambda: f"{word(1, 1).capitalize()}{rnd.randint(2, 64)}{word().capitalize()}", lambda: self.pick(UP, 2, 6) + word(1, 3).capitalize(), lambda: word().capitalize() + self.pick(UP, 2, 5), lambda: rnd.choice("abcdefghijklmnxyz") + rnd.choice(("", "1", "2", "_")),
        ))()

    def code(self, depth: int = 2) -> str:
        """A piece of source code without a secret, in which names of secrets are names like others."""
        name, rnd, pick = self.name, self.rnd, self.pick
        inner = (lambda: self.code(depth - 1)) if depth else name
        return rnd.choice((
            lambda: f"{name()} = {inner()}", lambda: f"{name()}.{name()}.{name()}({inner()})", lambda: f"{name()}({inner()}, {name()}={inner()})", lambda: f"def {name()}(self, {name()}=None, *{name()}):\n    {inner()}", lambda: f"function {name()}({name()}, {name()}) {{ {inner()}; }}",
            lambda: f"self.{name()} = {name()}[{inner()}]", lambda: f"if ({name()} == {inner()} && !{name()}.{name()}) {{", lambda: f"return {inner()} + {name()}.{name()}", lambda: f"import {name()}.{name()}", lambda: f"from {name()} import {name()}, {name()}", lambda: f"class {name()}({name()}):",
            lambda: f"var {name()} = '{self.prose(1, 4)}';", lambda: f'{name()}: "{name()}.{name()}",', lambda: f"0x{pick('0123456789abcdef', 2, 8)}", lambda: f"0x{pick('0123456789ABCDEF', 2, 8)} << {rnd.randint(1, 31)}", lambda: f"{rnd.randint(0, 99999)}.{rnd.randint(0, 999)}", lambda: f"#{pick('0123456789abcdef', 6)}",
            lambda: f"'/{name()}/{name()}/{name()}.{rnd.choice(('py', 'js', 'png', 'txt', 'h'))}'", lambda: f"{name()}/{name()}.{rnd.choice(('py', 'js', 'css'))}", lambda: f"https://{self.word()}.{rnd.choice(('com', 'org', 'io'))}/{name()}/{name()}#{name()}", lambda: f"# {self.prose(2, 8)}", lambda: f"// {name()}: {self.prose(1, 5)}", lambda: f"{name()}->{name()} {inner()}",
            lambda: f"'{'%' + rnd.choice('sdr')} {self.word()} {{{name()}!r}}' % {inner()}", lambda: f"\\x{pick('0123456789abcdef', 2)}\\x{pick('0123456789abcdef', 2)}", lambda: f"{name().upper()}|{name().upper()}|{name().upper()}", lambda: f"{rnd.choice(NOUNS)} = {rnd.choice(NOUNS)}", lambda: f"{rnd.choice(NOUNS)}={rnd.choice(('None', 'null', 'true', '0', name(), name() + '()'))}",
            lambda: ", ".join(f"{k}{i}" for k in [self.word(1, 1)] for i in range(1, rnd.randint(3, 5))), lambda: f"[{', '.join('0x' + pick('0123456789abcdef', 2) for _ in range(rnd.randint(3, 12)))}]", lambda: f"'{self.word(1, 1)}{rnd.randint(1, 512)}', '{self.word(1, 1)}{rnd.randint(1, 512)}', '{name()}'", lambda: "/".join(name() for _ in range(rnd.randint(2, 4))), lambda: pick(DIGITS, 9, 40), lambda: f"[{', '.join(str(rnd.randint(0, 4000)) for _ in range(rnd.randint(2, 9)))}]", lambda: f"{{{', '.join(f'{name()}: {name()}' for _ in range(rnd.randint(1, 4)))}}}",
        ))()


def generated(n: int = GENERATED, seed: int = 1) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up lines with the places of their secrets, of which four in ten hold one, and CODE pieces of made-up source code, a few with one."""
    made, out = Made(seed), []
    for _ in range(n):
        out.append(planted(made.prose(), made.prose(), made) if made.rnd.random() < 0.4 else (f"{made.prose()} {made.likeness()} {made.prose()}", []))
    for _ in range(CODE):
        lines = ["\n".join(made.code() for _ in range(made.rnd.randint(1, 2))) for _ in range(2)]
        out.append(planted(*lines, made) if made.rnd.random() < 0.15 else ("\n".join(lines), []))
    return out


def planted(head: str, tail: str, made: Made) -> tuple[str, list[tuple[int, int]]]:
    """A line with a secret between two parts of it, and the secret's place."""
    lead, s = made.secret()
    quote = made.rnd.choice(("", "", "", "'", '"')) if "\n" not in s else ""
    if "://" in lead:  # the password of an address, its host behind it
        before = f"{head}{made.rnd.choice((' ', ' ', chr(10), '=', chr(34)))}{lead}"
        return f"{before}{s}@{made.host()}{made.rnd.choice((' ', chr(34), chr(39), chr(10)))}{tail}", [(len(before), len(before) + len(s))]
    close = "'" if lead.endswith("'") else '"' if lead.endswith('"') else quote
    before = f"{head}{made.rnd.choice((' ', ' ', chr(10)))}{lead}{quote if close == quote else ''}"
    return f"{before}{s}{close}{made.rnd.choice((' ', ' ', '. ', chr(10)))}{tail}", [(len(before), len(before) + len(s))]


def passages(text: str, h: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Up to PASSAGES pieces of a text with the places of base matches in them: half of them around such matches."""
    parts = sorted({p for _, p in base_spans(text)})
    rnd = random.Random(h)
    centres = [a for a, _ in rnd.sample(parts, min(len(parts), PASSAGES // 2))]
    out = []
    for c in centres + [rnd.randrange(len(text)) for _ in range(PASSAGES - len(centres))]:
        a, b = max(0, c - AROUND), min(len(text), c + AROUND + 60)
        while a and not text[a - 1].isspace() and a > c - 2 * AROUND:
            a -= 1
        while b < len(text) and not text[b].isspace() and b < c + 2 * AROUND:
            b += 1
        out.append((text[a:b], [(max(p, a) - a, min(q, b) - a) for p, q in parts if p < b and a < q]))
    return out


def _unnamed(text: str, parts: list[tuple[int, int]], made: Made) -> tuple[str, list[tuple[int, int]]]:
    """The passage with the names before its secrets replaced."""
    out, at, places = "", 0, []
    for a, b in parts:
        head = re.sub(r"password|passwd|secret|token|api_?key", lambda _: made.rnd.choice(PLAINLY), text[at:a], flags=re.I)
        out += head
        places.append((len(out), len(out) + b - a))
        out += text[a:b]
        at = b
    return out + text[at:], places


#: Fields that a driver keeps, of a megabyte at most each, by the passages that they were trained on.
FIELDS = 4
_FIELDS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = SAMPLE) -> Broadcast:
    """A field trained on generated examples and passages of at most `most` documents of the corpus, sent to the executors."""
    rows = need(docs, key, text).filter(F.length(text) > 0)
    named = F.xxhash64(key, F.crc32(F.col(text).cast("binary")))
    chosen = rows.select(named.alias("h")).distinct().orderBy("h").limit(most // 2)
    # Documents in which base patterns may match are few, so they have a half of their own.
    likely = rows.filter(F.col(text).rlike(r"(?i)[0-9a-f]{16}|AKIA|(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")).select(named.alias("h")).distinct().orderBy("h").limit(most - most // 2)
    sample = rows.withColumn("h", named).join(F.broadcast(chosen.union(likely).distinct()), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(h, k, t, [x for p in parts for x in p]) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (t, parts) in enumerate(passages(text, h))]
            h, k, t, p = zip(*made, strict=True) if made else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int32()), pa.array(t, pa.string()), pa.array(p, pa.list_(pa.int32()))], ["h", "k", "t", "p"])

    # PASSAGES pieces of some hundred characters of each sampled document come to the driver.
    got = sample.select("h", text).mapInArrow(run, "h long, k int, t string, p array<int>").dropDuplicates(["h", "k"]).orderBy("h", "k").limit(PASSAGES * most).toArrow().to_pydict()
    found = [(t, list(zip(p[::2], p[1::2], strict=True))) for t, p in zip(got["t"], got["p"], strict=True)]
    mark = hashlib.md5(repr(found).encode("utf-8", "replace")).hexdigest()
    if mark not in _FIELDS:
        if len(_FIELDS) >= FIELDS:
            _FIELDS.clear()
        _FIELDS[mark] = field(found)
    return docs.sparkSession.sparkContext.broadcast(_FIELDS[mark])


def field(found: list[tuple[str, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """The model from passages and the places of their base matches."""
    made = Made(7)
    lines = generated()
    for t, parts in found:
        if not parts and made.rnd.random() < 0.3:
            cuts = [m.start() for m in re.finditer(" ", t)] or [len(t)]
            at = made.rnd.choice(cuts)
            lines.append(planted(t[:at], t[at + 1 :], made))
    examples = [x for t, parts in lines for x in examples_of(t, parts)]
    if found:
        first = Scores(train(examples, EPOCHS // 2))
        clean = [t for t, parts in found if not parts]
        # A base match is sure, but its absence is not: a passage without one serves where a first field finds none either.
        sure = [(t, []) for t, spans in zip(clean, crf_spans(clean, first), strict=True) if not spans]
        matched = [x for x in found if x[1]]
        examples += [x for t, parts in sure + matched + [_unnamed(*m, made) for m in matched] for x in examples_of(t, parts)]
    return train(examples)


def find(texts: list[str | None], scores: Scores) -> Iterator[tuple[list[Span], list[Span], list[tuple[int, int]]]]:
    """Base spans, all spans, and the secret parts, of each text."""
    for at in slices(texts):
        some = [t or "" for t in texts[at]]
        for t, crf in zip(some, crf_spans(some, scores), strict=True):
            base = base_spans(t)
            spans = [s for s, _ in base]
            more = [s for s in crf if not any(s[1] < b and a < s[2] for _, a, b in spans)]
            every = sorted(spans + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            yield spans, every, sorted([p for _, p in base] + [s[1:] for s in more])


def masked(text: str | None, parts: list[tuple[int, int]], mask: str = "<SECRET>") -> str | None:
    """The text with its secret parts replaced."""
    out, at = [], 0
    for a, b in parts:
        if b > at:
            if a >= at:
                out += [text[at:a], mask]
            at = b
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, model: Broadcast, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_assign, n_access, n_hex, n_crf, base_sha256, spans."""
    rows = need(docs, *keys, text)
    names = ["n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.value)
        for batch in batches:
            made = []
            for base, every, _ in find(batch.column(batch.schema.get_field_index(text)).to_pylist(), scores):
                kinds = Counter(k for k, _, _ in every)
                made.append((*(kinds[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*made, strict=True)) if made else [()] * 6
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns))], [*keys, *names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, T.LongType() if i < 4 else T.StringType()) for i, n in enumerate(names))]))


def redact(docs: DataFrame, model: Broadcast, text: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """The same rows and columns, secrets in the text replaced. Only changed texts come back from the workers."""
    held: list[Scores] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scores(model.value))
        given = texts.to_pylist()
        new = (masked(t, parts, mask) for t, (_, _, parts) in zip(given, find(given, held[0]), strict=True))
        return pa.array([n if n != t else None for t, n in zip(given, new, strict=True)], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(text, F.coalesce(F.arrow_udf(run, "string")(text), text))
