"""SQL texts of the hot text functions, for use in ``expr``.

One ``expr`` call parses a whole function inside the JVM; building the same
tree call by call from Python costs a round trip per node, which shows when a
plan uses these functions dozens of times.
"""

from __future__ import annotations

from quillstone.functions import values as V

# Unicode whitespace, written out so that one character map can drop it.
SPACES = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ),
    )
)
BLOCK = 256
NO_TEXTS = "cast(array() as array<string>)"


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    escaped = "".join(
        "\\\\" if c == "\\" else "\\'" if c == "'" else c if 32 <= ord(c) < 127 or ord(c) > 0x3000 else f"\\u{ord(c):04x}"
        for c in text
    )
    return f"'{escaped}'"


def text(x: str) -> str:
    return f"coalesce(cast({x} as string), '')"


def drop(x: str, characters: str) -> str:
    return f"translate({x}, {literal(SPACES + characters)}, '')"


def normalize(x: str) -> str:
    return drop(f"lower({text(x)})", V.QUESTION_PUNCTUATION)


def core(x: str) -> str:
    for phrase in V.FILLER_PHRASES:
        x = f"replace({x}, {literal(phrase)}, '')"
    return x


def let(name: str, value: str, body: str) -> str:
    """``body`` with the lambda variable ``name`` bound once to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def cuts(x: str, size: int, step: int = 1) -> str:
    """Substrings of ``size`` characters at every ``step``; see ``text.grams``."""
    stride = BLOCK - BLOCK % step

    def pieces(block: str) -> str:
        last = f"least(length({block}) - {size}, {stride - 1})"
        return (
            f"if({last} >= 0, transform(sequence(0, greatest({last}, 0), {step}), "
            f"i_{size} -> substring({block}, i_{size} + 1, {size})), {NO_TEXTS})"
        )

    whole = f"w_{size}"
    long = (
        f"flatten(transform(transform(sequence(0, greatest(length({whole}) - 1, 0), {stride}), "
        f"s_{size} -> substring({whole}, s_{size} + 1, {size + stride - 1})), b_{size} -> {pieces(f'b_{size}')}))"
    )
    return let(whole, x, f"if(length({whole}) <= {BLOCK}, {pieces(whole)}, {long})")


def tokens(x: str) -> str:
    def run_grams(n: int) -> str:
        return (
            f"if(length(run) >= {n}, transform(sequence(1, greatest(length(run) - {n - 1}, 1)), "
            f"p{n} -> substring(run, p{n}, {n})), {NO_TEXTS})"
        )

    cjk = (
        f"flatten(transform(regexp_extract_all({text(x)}, '[\\\\x{{4e00}}-\\\\x{{9fff}}]+', 0), run -> "
        f"if(length(run) = 1, array(run), concat({run_grams(2)}, {run_grams(3)}, {run_grams(4)}, "
        f"if(length(run) <= 10, array(run), {NO_TEXTS})))))"
    )
    words = f"filter(regexp_extract_all(lower({text(x)}), '[a-z0-9+#_.-]+', 0), word -> length(word) >= 2)"
    return f"array_distinct(concat({words}, {cjk}))"
