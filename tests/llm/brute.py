"""Plain versions of the contracts: one document at a time, or all pairs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans) -> str:
    """spans: (start, rank, end, kind)"""
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def secret_spans(text: str | None) -> list[tuple]:
    text, found = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in re.finditer(r"""(?=((https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.-]+(:[0-9]+)?[^\x20\t\r\n"'<>]*))""", text) for m in [re.compile(r"""[a-z0-9]+://[A-Za-z0-9.-]+(:[0-9]+)?[^\x20\t\r\n"'<>]*""").match(text, m.start())]]


def weak_parts(text: str) -> list[tuple]:
    """Weak candidates (start, rank, end, kind) that overlap nothing found before them."""
    found = [(m.start(), 3, m.end(), "ident") for m in re.finditer(r"""(client|account|user|tenant)[_-]?(id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", text, re.I | re.A)]
    found += [(m.start(), 4, m.end(), "endpoint") for m in re.finditer(r"(https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.-]+(:[0-9]+)?", text)]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        key = m.group()
        if any(a < m.end() and m.start() < b for a, b in addresses(text)):
            continue
        if re.fullmatch(r"[A-Za-z0-9+/_-]{32,64}={0,2}", key) and all(re.search(c, key) for c in ("[0-9]", "[A-Z]", "[a-z]")):
            found.append((m.start(), 5, m.end(), "bare"))
    kept, taken = [], secret_spans(text)
    for p in found:
        if all(p[2] <= q[0] or q[2] <= p[0] for q in taken):
            kept.append(p)
            taken.append(p)
    return kept


def secret_links(text: str | None, reach: int = 400) -> tuple[list[tuple], int, str]:
    """(reported spans, number of linked parts, links) over all pairs of parts."""
    text = text or ""
    parts = sorted(secret_spans(text) + weak_parts(text))
    role = {"access": 0, "ident": 0, "assign": 1, "hex": 1, "bare": 1, "endpoint": 2}
    scope = lambda p: len([m for m in re.finditer(r"\n[\x20\t\r]*\n", text) if m.start() < p[0]])
    spans, links, n = [], [], 0
    for p in parts:
        best: dict = {}
        for q in parts:
            if role[p[3]] == role[q[3]] or abs(p[0] - q[0]) > reach or not (p[2] <= q[0] or q[2] <= p[0]) or scope(p) != scope(q):
                continue
            gap = max(q[0] - p[2], p[0] - q[2])
            best[role[q[3]]] = min(best.get(role[q[3]], (gap, q)), (gap, q))
        linked = {0: 1 in best, 1: 0 in best or 2 in best, 2: 0 in best and 1 in best}[role[p[3]]]
        n += linked
        if linked or p[1] < 3:
            spans.append(p)
        if linked and role[p[3]] == 1:
            links.append("|".join(f"{x[3]}:{x[0]}:{x[2]}" if x else "" for x in (p, *[best[r][1] if r in best else None for r in (0, 2)])))
    return spans, n, ",".join(links)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_spans(text: str | None) -> list[tuple]:
    text, found = text or "", []
    found += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return found


ACCOUNT_LENGTHS = {"DE": 22, "BE": 16, "AT": 20, "NL": 18, "NO": 15}


def account_spans(text: str) -> list[tuple]:
    """Account numbers of the countries above: the one part of a country's length that passes, if any does."""
    found = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))", text):
        whole = m.group() + m.group(1)
        for end in range(len(whole), 11, -1):
            plain = whole[:end].replace(" ", "")
            if whole[end : end + 1] in ("", " ") and len(plain) == ACCOUNT_LENGTHS.get(m.group()[:2]) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                found.append((m.start(), 4, m.start() + end, "iban"))
                break
    return found


SCORES = {"email": (0.8, "e-?mail|contact|write|mailto"), "ip": (0.6, "ip|host|server|address|login"), "card": (0.7, "card|visa|mastercard|credit|payment"), "phone": (0.5, "phone|tel|call|mobile|fax"), "iban": (0.8, "iban|account|bank|bic")}


def pii_scores(text: str | None) -> tuple[str, str, float]:
    """(spans, scores, mean score) with the words within 40 code points of each span."""
    text = text or ""
    spans, scores = sorted(pii_spans(text) + account_spans(text)), []
    for a, _, b, kind in spans:
        sure, words = SCORES[kind]
        near = text[max(0, a - 40) : a] + " " + text[b : b + 40]
        told = lambda w: re.search(rf"\b({w})\b", near, re.I) is not None
        scores.append(round(max(0.0, min(1.0, sure + 0.15 * told(words) - 0.25 * told("example|sample|test|version|order|invoice"))), 2))
    return joined(spans), ",".join(f"{s:.2f}" for s in scores), round(sum(scores) / len(scores), 4) if scores else 0.0


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs, items, width: int = 10) -> list[tuple]:
    """docs, items: (id, text) -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans)"""
    windows = defaultdict(set)
    for item, text in items:
        ws = bench_words(text)
        if item is not None:
            for k in range(max(1, len(ws) - width + 1) if ws else 0):
                windows[tuple(ws[k : k + width])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        ws, hit, found = bench_words(text), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if got := windows.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        spans = ",".join(f"{a}:{min(b for b in range(a, len(ws) + 1) if b not in hit)}" for a in sorted(hit) if a - 1 not in hit)
        out.append((doc, len(ws), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit), spans))
    return out


def shingles(text: str | None, width: int = 5) -> set[tuple]:
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))} if ws else set()


def near_components(docs, percent: int = 85, width: int = 5) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component_id, kept), over all pairs."""
    sets = {d: shingles(t, width) for d, t in docs}
    above = {d: d for d in sets}

    def top(d):
        while above[d] != d:
            d = above[d]
        return d

    order = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                above[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def url_rule(url: str | None) -> tuple[str, str, str | None, str | None]:
    """(host, path, rule, verdict of the rule)"""
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = lower(m.group(1)), m.group(2)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def rebuilt_dialogues(rows) -> dict[int, list[tuple[str, str]]]:
    """rows: (conv_id, turn, role, text) -> the turns of each rebuilt conversation"""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    return out


def trie_nodes(rows) -> list[tuple]:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), by recursion"""
    dialogues = rebuilt_dialogues(rows)
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in dialogues.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out, order = {}, sorted(members, key=len, reverse=True)
    for node in order:
        below = [out[k] for k in kids[node]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        ends = sha(",".join(str(c) for c in sorted(members[node]) if len(dialogues[c]) == len(node)))
        up = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), up, len(members[node]), len(below), sum(b[5] for b in below) or 1, (len(members[node]) - 1) * words + sum(b[6] for b in below), ends)
    return list(out.values())


def spelling(docs) -> list[tuple]:
    """docs: (id, text) -> (word, form, root, n, n_near, form_n), every word held against every other"""
    count: dict[str, int] = defaultdict(int)
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [o for o in count if abs(len(o) - len(w)) <= 1 and one_edit(w, o)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items()]
