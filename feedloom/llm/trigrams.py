"""Boolean trigram queries: what a text must contain for a regex to match at all."""

from __future__ import annotations

import re._constants as sc
import re._parser as sre

MOST = 32  # exact strings followed at once; more alternatives count as "anything"

Clause = list[list[str]]  # any of these, each needing all of its trigrams


def _strings(nodes) -> list[list[str] | None]:
    """The pattern as a row of pieces: the exact strings a piece can be, or None."""
    out: list[list[str] | None] = []
    for op, arg in nodes:
        if op is sc.LITERAL:
            out.append([chr(arg).lower()])
        elif op is sc.SUBPATTERN:
            out += _strings(arg[-1])
        elif op is sc.BRANCH:
            whole = [_flat(_strings(b)) for b in arg[1]]
            out.append(None if any(w is None for w in whole) else [s for w in whole for s in w])
        elif op is sc.IN and all(o is sc.LITERAL for o, _ in arg):
            out.append(sorted({chr(c).lower() for _, c in arg}))
        elif op is sc.MAX_REPEAT or op is sc.MIN_REPEAT:
            low, high, sub = arg
            inner = _flat(_strings(sub))
            if inner is not None and (low, high) == (0, 1):
                out.append(["", *inner])
            else:
                out += [inner] * min(low, 3) if inner is not None else [None]
                if high != low or low > 3:  # what follows is not next to the third copy
                    out.append(None)
        elif op is not sc.AT:
            out.append(None)
    return out


def _flat(pieces) -> list[str] | None:
    made = [""]
    for p in pieces:
        if p is None or len(made) * len(p) > MOST:
            return None
        made = [a + b for a in made for b in p]
    return made


def required(pattern: str) -> list[Clause]:
    """All clauses must hold.  An empty list: no trigram is mandatory, scan fully.

    Trigrams are lower case and are looked up in lower-cased text, so the answer holds for
    either case; it may let a text through that does not match, never the reverse.
    """
    clauses: list[Clause] = []
    run: list[str] = [""]

    def close():
        if all(len(s) >= 3 for s in run):
            alternatives = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            least = [a for a in alternatives if not any(b < a for b in alternatives)]  # a wider one adds nothing
            clauses.append(sorted(sorted(a) for a in least))

    for piece in _strings(sre.parse(pattern)):
        if piece is not None and len(run) * len(piece) <= MOST:
            run = [a + b for a in run for b in piece]
            continue
        close()
        run = piece if piece is not None and len(piece) <= MOST else [""]
    close()
    return clauses
