"""Brute-force model of matching, for small inputs. Independent of Spark."""

from __future__ import annotations

import hashlib
import re


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def indel(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    total = len(a) + len(b)
    return (1.0 - (total - 2 * lcs(a, b)) / total) * 100.0


def words_sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def norm(s) -> str:
    return " ".join(re.findall(r"\w+", (s or "").lower()))


NOISE = set("inc incorporated corp corporation llc ltd limited co company plc lp llp pllc pc pa na the a an".split())
SHORT = dict(street="st", avenue="ave", road="rd", boulevard="blvd", drive="dr", lane="ln", court="ct", place="pl",
             suite="ste", apartment="apt", building="bldg", floor="fl", north="n", south="s", east="e", west="w")


def company(s) -> str:
    return " ".join(w for w in norm(s).split() if w not in NOISE)


def address(s) -> str:
    return " ".join(SHORT.get(w, w) for w in norm(s).split())


def phone(s) -> str:
    digits = "".join(c for c in s or "" if c.isdecimal())
    return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits


def compare(kind: str, a: str, b: str) -> float:
    if kind == "company":
        return indel(words_sorted(company(a)), words_sorted(company(b)))
    if kind == "address":
        return indel(words_sorted(address(a)), words_sorted(address(b)))
    if kind == "phone":
        return 100.0 if phone(a) and phone(a) == phone(b) else 0.0
    return indel(words_sorted(a), words_sorted(b))


KINDS = {"COMPANY_NAME": "company", "ADDRESS_LINE_1": "address", "ADDRESS_LINE_2": "address", "PHONE_NUMBER": "phone"}


def holds(condition, left: dict, right: dict) -> bool:
    a, b = ((r.get(condition.field) or "").strip() for r in (left, right))
    if condition.blank:
        return a == "" and b == ""
    if a == "" or b == "":
        return condition.blank_allowed
    score = compare(KINDS.get(condition.field, "text"), a, b)
    return (score >= condition.percentage) == condition.include


def block(r: dict) -> str:
    return "_".join([company(r["COMPANY_NAME"])[:3], (r["ZIP_CODE"] or "")[:5], phone(r["PHONE_NUMBER"])[-4:]]).lower()


def data_hash(r: dict) -> str:
    parts = [(r["SOURCE_TYPE"] or "").strip().upper(), (r["SOURCE_ID"] or "").strip(), company(r["COMPANY_NAME"]),
             address(r["ADDRESS_LINE_1"]), phone(r["PHONE_NUMBER"])]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def key_of_hash(h: str) -> str:
    d = hashlib.sha256(f"dedup-key:{h}".encode()).hexdigest()
    return f"{d[:8]}-{d[8:12]}-8{d[13:16]}-a{d[17:20]}-{d[20:32]}"


def matches(records: list[dict], rules) -> dict[int, tuple[int, str]]:
    """Record number -> (partner, rule id)."""
    out = {}
    for i, left in enumerate(records):
        later = [j for j in range(i + 1, len(records)) if block(records[j]) == block(left)]
        hits = (
            (j, rule.id) for rule in rules for j in later if all(holds(c, left, records[j]) for c in rule.conditions)
        )
        first = next(hits, None)
        if first:
            out[i] = first
    return out


def all_links(records: list[dict], rules) -> list[tuple[int, int]]:
    n = len(records)
    return [
        (i, j) for i in range(n) for j in range(i + 1, n)
        if block(records[i]) == block(records[j])
        and any(all(holds(c, records[i], records[j]) for c in r.conditions) for r in rules)
    ]


def assign_keys(records: list[dict], found: dict, store: dict[str, str]) -> tuple[list, dict, dict]:
    """Keys one record at a time: (key, is new, identifiers) per record, final map, links."""
    current, linked, rows = dict(store), {}, []
    for i, r in enumerate(records):
        h, fresh = data_hash(r), False
        brought = records[found[i][0]].get("DEDUP_KEY") if i in found else None
        name = f"{r['SOURCE_TYPE'] or ''}:{r['SOURCE_ID'] or ''}"
        if brought:
            current[h] = brought
        elif h not in current:
            current[h], fresh = key_of_hash(h), True
        key = current[h]
        if fresh or i in found:
            linked.setdefault(key, dict())[name] = None
        rows.append((key, fresh, "|".join(linked[key]) if i in found else ""))
    return rows, current, linked
