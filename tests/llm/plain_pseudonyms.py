"""The pseudonyms of a text in plain Python, from the patterns and fixed values alone; for tests."""

import datetime
import hashlib
import re

from splitforge.llm import pseudonyms as P

PATTERN = re.compile(P.PATTERN, re.ASCII)
FORMS = {k: re.compile(v, re.ASCII) for k, v in P.FORMS.items()}
FIRST = datetime.date.fromisoformat(P.FIRST_DAY)


def digest(key, tweak, turn, half):
    return hashlib.sha512(f"{key}|{tweak}|{turn}|{half}".encode()).hexdigest()


def moved(char, by):
    for first, size in (("0", 10), ("a", 26), ("A", 26)):
        if first <= char <= chr(ord(first) + size - 1):
            return chr((ord(char) - ord(first) + by) % size + ord(first))
    return char


def text(value, key, tweak):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for turn in range(8):
        h = digest(key, tweak, turn, right)
        left, right = right, "".join(moved(c, int(h[8 * i : 8 * i + 8], 16)) for i, c in enumerate(left))
    return left + right


def pieces(value, key, tweak):
    parts = [value[i : i + 32] for i in range(0, len(value), 32)] or [""]
    return "".join(text(p, key, tweak + (str(i) if i else "")) for i, p in enumerate(parts))


def pair(number, high, low, key, tweak):
    h, w = divmod(number, low)
    for turn in range(8):
        if turn % 2 == 0:
            h = (h + int(digest(key, tweak, turn, w)[:14], 16)) % high
        else:
            w = (w + int(digest(key, tweak, turn, h)[:14], 16)) % low
    return h * low + w


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))


def iban_rest(plain):
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def laid(form, plain):
    chars = iter(plain)
    return "".join(next(chars) if c.isalnum() else c for c in form)


def is_card(plain):
    return 13 <= len(plain) <= 19 and any(a <= int(plain[:4]) <= b and c <= len(plain) <= d for a, b, c, d in P.ISSUERS) and luhn(plain) % 10 == 0


def cards(run):
    groups, out, at, i = re.split("[ -]", run), [], 0, 0
    while i < len(groups):
        for k in range(min(19, len(groups) - i), 0, -1):
            if is_card("".join(groups[i : i + k])):
                end = at + len(" ".join(groups[i : i + k]))
                out.append((at, end))
                at, i = end + 1, i + k
                break
        else:
            at, i = at + len(groups[i]) + 1, i + 1
    return out


def card(value, key):
    plain = re.sub(r"\D", "", value)
    stay = 1 if plain[0] == "4" else 4
    body = plain[:stay] + text(plain[stay:-1], key, "card")
    return laid(value, body + str(-luhn(body + "0") % 10))


def date(year, month, day):
    try:
        return (datetime.date(int(year), int(month), int(day)) - FIRST).days
    except ValueError:
        return None


def other_day(n, key):
    span = n // 73_000
    begin, high, low = P.EDGES.get(span, (span * 73_000, 250, 292))
    return begin + pair(n - begin, high, low, key, f"date{span}")


def as_date(n):
    return FIRST + datetime.timedelta(days=n)


def one(value, key):
    """(kinds, new value) of a candidate."""
    kind = next((k for k, p in FORMS.items() if p.fullmatch(value)), None)
    digits = re.sub(r"\D", "", value)
    if kind == "email":
        name, _, domain = value.partition("@")
        return ["email"], pieces(name, key, f"email|{domain.lower()}") + "@" + domain
    if kind in ("secret", "access_key"):
        head = re.match(r"[A-Za-z_]+\s{0,3}[=:]\s{0,3}[\"']?", value).group() if kind == "secret" else "AKIA"
        return [kind], head + pieces(value[len(head) :], key, kind)
    if kind == "iban":
        plain = value.replace(" ", "")
        if 15 <= len(plain) <= 34 and iban_rest(plain) == 1:
            account = text(plain[4:], key, "iban")
            return ["iban"], laid(value, plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + account):02d}" + account)
    if kind == "phone" and 7 <= len(digits) <= 15:
        stay = 2 if value[0] == "+" else 1
        return ["phone"], laid(value, digits[:stay] + text(digits[stay:], key, "phone"))
    if kind == "iso_date" and (n := date(value[:4], value[5:7], value[8:])) is not None:
        return ["iso_date"], as_date(other_day(n, key)).isoformat()
    if kind == "day_date":
        a, b, year = value[:2], value[3:5], value[6:]
        if (n := date(year, b, a)) is not None:
            d = as_date(other_day(n, key))
            return ["day_date"], f"{d.day:02d}{value[2]}{d.month:02d}{value[5]}{d.year:04d}"
        if (n := date(year, a, b)) is not None:
            n = other_day(n, key)
            while as_date(n).day <= 12:
                n = other_day(n, key)
            d = as_date(n)
            return ["month_date"], f"{d.month:02d}{value[2]}{d.day:02d}{value[5]}{d.year:04d}"
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        if 0 < area < 900 and area != 666 and group and serial:
            base, areas = (1, 665) if area < 666 else (667, 233)
            n = pair((area - base) * 989_901 + (group - 1) * 9999 + serial - 1, areas, 989_901, key, "ssn")
            return ["ssn"], f"{n // 989_901 + base:03d}-{n % 989_901 // 9999 + 1:02d}-{n % 989_901 % 9999 + 1:04d}"
    if kind == "ip":
        parts = list(map(int, value.split(".")))
        if max(parts) < 256:
            n = pair(int.from_bytes(bytes(parts)), 65536, 65536, key, "ip")
            return ["ip"], ".".join(map(str, n.to_bytes(4)))
    if kind == "card" and (found := cards(value)):
        out, at = "", 0
        for a, b in found:
            out += value[at:a] + card(value[a:b], key)
            at = b
        return ["card"] * len(found), out + value[at:]
    return [], value


def pseudonymised(whole, key):
    """(new text, kinds) of a text."""
    out, kinds, at = "", [], 0
    for match in PATTERN.finditer(whole or ""):
        if match.group():
            more, new = one(match.group(), key)
            out += whole[at : match.start()] + new
            kinds += more
            at = match.end()
    return (out + whole[at:] if whole is not None else None), kinds
