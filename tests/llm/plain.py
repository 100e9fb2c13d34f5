"""Plain Python forms that several tests hold operators against."""

import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_hits(docs, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= items_
        out.append((doc, len(w), len(hit), sorted(found)))
    return Counter(map(repr, out))


SPANS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


MORE = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 0, 1),
    ("vendor", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35,}|sk_live_[0-9a-zA-Z]{24,}"), 0, 1),
    ("url", re.compile(r"(?:https?|ftps?|ssh|git|mysql|postgres(?:ql)?|mongodb|redis|amqps?)://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"), 0, 1),
]


def plain_secrets(text, more=False):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(SPANS + MORE if more else SPANS):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
