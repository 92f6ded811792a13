"""The support of a line by the other lines of its text."""

import random
import time

from quillstone.functions.support import line_status


def plain(lines):
    found = []
    for i, line in enumerate(lines):
        rest = "".join(lines[:i] + lines[i + 1 :])
        wide = [line[k : k + 20] in rest for k in range(0, len(line) - 19, 10)]
        narrow = [line[k : k + 8] in rest for k in range(0, len(line) - 7, 8)]
        found.append(
            "empty" if not line else "exact" if line in rest
            else "partial" if len(line) >= 16 and line[:40] in rest or any(wide)
            else "concept_supported" if sum(narrow) >= 2 else "unverified"
        )
    return found


def test_line_status_is_the_plain_definition():
    seen = set()
    for seed in range(400):
        r = random.Random(seed)
        letters = r.choice(["ab", "abc", "abcdefghijklmnop", "日本语abcdefghijk"])
        base = "".join(r.choices(letters, k=r.randint(5, 120)))
        lines = []
        for _ in range(r.randint(0, 8)):
            at, noise = r.randint(0, len(base)), "".join(r.choices(letters, k=r.randint(0, 12)))
            lines.append(r.choice([base[at : at + r.randint(0, 60)], noise, "", noise + base[at : at + r.randint(8, 45)] + noise]))
        found = line_status(lines)
        seen.update(found)
        assert found == plain(lines), lines
    assert len(seen) == 5


def test_a_line_is_found_across_the_place_where_it_is_taken_out():
    assert line_status(["xxab", "abcd", "cdyy"]) == ["unverified", "exact", "unverified"]


def test_a_long_text_takes_a_pass_and_not_one_for_every_line():
    r = random.Random(1)
    lines = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(8_000)]
    start = time.time()
    assert line_status([*lines, lines[5]])[5] == "exact"
    assert time.time() - start < 20
