"""Small texts with near and exact copies, made from a seed."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(n)]


def edited(ws, places, seed):
    r, out = random.Random(seed), list(ws)
    for k in range(places):
        out[r.randrange(len(out))] = f"edit{seed}x{k}"
    return out
