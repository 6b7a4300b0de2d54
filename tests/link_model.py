"""Brute-force, character-at-a-time model of the link scanner (test oracle).

Written from the scan rules in ``linkloom.functions.links``; used only by tests
to check the regex form on fixtures and random strings.
"""

import string

# RFC 3986: unreserved, reserved and the percent sign.
_LEGAL = {*string.ascii_letters, *string.digits, *"-._~", *":/?#[]@", *"!$&'()*+,;=", "%"}


def scan_links(doc: str) -> list[str]:
    out: list[str] = []
    n = len(doc)
    i = 0

    def add(v):
        if v not in out:
            out.append(v)

    def find_href(pos):
        """Subsequence 'href=' before '>'; index after '=' or None."""
        want = "href="
        k = 0
        while pos < n:
            c = doc[pos]
            pos += 1
            if c == want[k]:
                k += 1
                if k == len(want):
                    return pos
            elif c == ">":
                return None
        return None

    while i < n:
        c = doc[i]
        i += 1
        if c == "<":
            if i < n and doc[i] == "a":
                i += 1
                while True:
                    j = find_href(i)
                    if j is None:
                        break
                    if j < n and doc[j] in "'\"":
                        j += 1
                        start = j
                        while j < n and doc[j] not in ">\"'":
                            j += 1
                        value = doc[start:j]
                        if j < n:
                            j += 1
                        if value:
                            add(value)
                        i = j
                    else:
                        i = j
                        break
        elif c == "h":
            while doc.startswith("ttp", i):
                i += 3
                secure = False
                if i < n and doc[i] == "s":
                    secure = True
                    i += 1
                    if i < n and doc[i] == ":":
                        i += 1
                    else:
                        continue
                elif i < n and doc[i] == ":":
                    i += 1
                else:
                    continue
                if not doc.startswith("//", i):
                    continue
                i += 2
                start = i
                while i < n and doc[i] in _LEGAL:
                    i += 1
                rest = doc[start:i]
                if i < n:
                    i += 1
                if rest:
                    add("http" + ("s" if secure else "") + "://" + rest)
    return out
