"""Reproducible draws by (seed, replicate, position): whole-number arithmetic, same on every engine."""

from pyspark.sql import functions as F

# The modulus is the Mersenne prime 2^31 - 1; each half of a draw has odd primes of its own as factors of the
# position's low, middle and high bits, the replicate, and the seed.
MODULUS = 2147483647
FACTORS = ((1299709, 32452843, 49979687, 15485863, 7919), (86028121, 67867967, 22801763, 104395301, 104729))


def _word(seed, rep, pos, low, middle, high, copy, salt):
    m = F.lit(MODULUS).cast("long")
    place = pos % 65536 * low + F.shiftright(pos, 16) % 65536 * middle + F.shiftright(pos, 32) * high
    first = (place + (rep.cast("long") % m) * copy + (int(seed) * salt % MODULUS + 12345)) % m

    def round_(h):
        return ((h % 65536) * 69621 + F.floor(h / 65536).cast("long") * 40692 + (h % 32749) * (h % 31337)) % m

    return round_(round_(first))


def seeded_hash(seed, rep, pos):
    """A whole number in [0, 2^62) from the three numbers; every bit of a position counts."""
    pos = (F.expr(pos) if isinstance(pos, str) else pos).cast("long")
    rep = F.lit(rep) if isinstance(rep, int) else rep
    return _word(seed, rep, pos, *FACTORS[0]) * F.lit(2147483648).cast("long") + _word(seed, rep, pos, *FACTORS[1])


def seeded_draw(seed, rep, pos, n):
    """A draw in [0, n)."""
    n = F.lit(n) if isinstance(n, int) else n
    return seeded_hash(seed, rep, pos) % n


def sql_hash(seed, rep, pos):
    """The same number as SQL text, for checking against another engine."""
    def word(low, middle, high, copy, salt):
        p = f"({pos})::BIGINT"
        place = f"(({p}) % 65536 * {low} + (({p}) >> 16) % 65536 * {middle} + (({p}) >> 32) * {high})"
        first = f"({place} + (({rep})::BIGINT % 2147483647) * {copy} + {int(seed) * salt % MODULUS + 12345}) % 2147483647"

        def round_(h):
            return f"((({h}) % 65536) * 69621 + (({h}) // 65536) * 40692 + (({h}) % 32749) * (({h}) % 31337)) % 2147483647"

        return round_(round_(first))

    return f"((({word(*FACTORS[0])})::BIGINT) * 2147483648 + ({word(*FACTORS[1])}))"
