"""Token-sort similarity (0-100) as a native expression.

The score is ``round(100 * 2 * LCS / (len a + len b))`` over the sorted tokens, halves to even.
The longest common subsequence comes from the bit-parallel recurrence of Crochemore et al. (2001)
and Hyyro (2004): one integer step per character of the longer text, with one bit per character of
the shorter one. Texts beyond one 64-bit word run the same recurrence over several words with a
carry, so no length is cut and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from platwork.functions.text import _col

# Bits used per word; leaves room for the addition without overflowing a signed long.
WORD_BITS = 61


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _char_masks(text: Column) -> Column:
    """Map from each distinct character to the bit set of its positions, last position lowest."""

    def masks(chars: Column) -> Column:
        def bits(ch: Column) -> Column:
            return F.aggregate(chars, _long(0), lambda acc, x: acc + acc + F.when(x == ch, _long(1)).otherwise(_long(0)))

        return _let(F.array_distinct(chars), lambda letters: F.map_from_arrays(letters, F.transform(letters, bits)))

    return _let(F.split(text, ""), masks)


def _mask_of(masks: Column, ch: Column) -> Column:
    return F.coalesce(F.try_element_at(masks, ch), _long(0))


def chars_from_end(text: Column) -> Column:
    # The masks number positions from the end, so the other text is read from its end too;
    # reversing both leaves the LCS unchanged.
    return F.reverse(F.split(text, ""))


def _lcs_one_word(longer: Column, shorter: Column) -> Column:
    def run(masks: Column) -> Column:
        full = F.call_function("shiftleft", _long(1), F.length(shorter)) - 1

        def step(ones: Column) -> Callable[[Column, Column], Column]:
            return lambda state, ch: _let(
                state.bitwiseAND(_mask_of(masks, ch)),
                lambda hit: (state + hit).bitwiseOR(state - hit).bitwiseAND(ones),
            )

        return _let(full, lambda ones: F.length(shorter) - F.bit_count(F.aggregate(chars_from_end(longer), ones, step(ones))))

    return _let(_char_masks(shorter), run)


def _lcs_many_words(longer: Column, shorter: Column) -> Column:
    full = _long((1 << WORD_BITS) - 1)
    word_count = F.ceil(F.length(shorter) / WORD_BITS).cast("int")
    # Word 1 holds the end of the text, since masks number positions from the end. Places past
    # the end of the last word match nothing and so keep their bit set.
    pieces = F.transform(
        F.sequence(F.lit(1), word_count),
        lambda k: F.reverse(F.substring(F.reverse(shorter), (k - 1) * WORD_BITS + 1, F.lit(WORD_BITS))),
    )

    def run(masks: Column) -> Column:
        def step(words: Column, ch: Column) -> Column:
            # Element 1 carries into the next word; the rest are the words done so far.
            def per_word(done: Column, k: Column) -> Column:
                word = F.element_at(words, k)
                return _let(
                    word.bitwiseAND(_mask_of(F.element_at(masks, k), ch)),
                    lambda hit: _let(
                        word + hit + F.element_at(done, 1),
                        lambda total: F.concat(
                            F.array(F.call_function("shiftright", total, F.lit(WORD_BITS))),
                            F.slice(done, F.lit(2), F.size(done) - 1),
                            F.array(total.bitwiseOR(word - hit).bitwiseAND(full)),
                        ),
                    ),
                )

            with_carry = F.aggregate(F.sequence(F.lit(1), word_count), F.array(_long(0)), per_word)
            return F.slice(with_carry, F.lit(2), word_count)

        last = F.aggregate(chars_from_end(longer), F.array_repeat(full, word_count), step)
        ones = F.aggregate(last, F.lit(0), lambda acc, w: acc + F.bit_count(w))
        return word_count * WORD_BITS - ones

    return _let(F.transform(pieces, _char_masks), run)


def token_sort_key(c: Column | str) -> Column:
    """ASCII only, lower case, words sorted and joined by one space; '' when nothing is left."""
    ascii_only = F.regexp_replace(_col(c), r"[^\x00-\x7F]", "")
    words = F.split(F.trim(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9_]+", " ")), " ")
    return F.array_join(F.sort_array(words), " ")


def key_ratio(a: Column, b: Column) -> Column:
    """Score of two values already made by :func:`token_sort_key`."""
    la, lb = F.length(a), F.length(b)
    longer = F.when(la >= lb, a).otherwise(b)
    shorter = F.when(la >= lb, b).otherwise(a)
    lcs = F.when(F.least(la, lb) <= WORD_BITS, _lcs_one_word(longer, shorter)).otherwise(_lcs_many_words(longer, shorter))
    return (
        F.when((la == 0) | (lb == 0), 0)
        .when(a == b, 100)
        .otherwise(F.bround(F.lit(200.0) * lcs / (la + lb), 0).cast("int"))
    )


# The characters that a key can have; a key's masks are stored in this order.
ALPHABET = " 0123456789_abcdefghijklmnopqrstuvwxyz"


def key_form(key: Column) -> Column:
    """What scoring needs of a key, made once for all its pairs: the ``key``, its ``codes``, the
    places of its characters in the alphabet, read from the end, and ``masks``, per character of the
    alphabet the bit set of its positions (null beyond one word)."""

    def form(codes: Column) -> Column:
        def bits(letter: Column) -> Column:
            return F.aggregate(F.reverse(codes), _long(0), lambda acc, x: acc + acc + F.when(x == letter, _long(1)).otherwise(_long(0)))

        letters = F.sequence(F.lit(1), F.lit(len(ALPHABET)))
        return F.struct(key.alias("key"), codes.alias("codes"), F.when(F.length(key) <= WORD_BITS, F.transform(letters, bits)).alias("masks"))

    spots = F.transform(chars_from_end(key), lambda ch: F.position(ch, F.lit(ALPHABET)).cast("tinyint"))
    return _let(F.when(key == "", F.array().cast("array<tinyint>")).otherwise(spots), form)


def _lcs_of_forms(masked: Column, scanned: Column) -> Column:
    size = F.length(masked["key"])

    def run(pair: Column) -> Column:
        masks, ones = pair["masks"], pair["ones"]

        def step(state: Column, code: Column) -> Column:
            return _let(
                state.bitwiseAND(F.element_at(masks, code.cast("int"))),
                lambda hit: (state + hit).bitwiseOR(state - hit).bitwiseAND(ones),
            )

        return size - F.bit_count(F.aggregate(scanned["codes"], ones, step))

    full = F.call_function("shiftleft", _long(1), size) - 1
    return _let(F.struct(masked["masks"].alias("masks"), full.alias("ones")), run)


def form_ratio(a: Column, b: Column) -> Column:
    """As :func:`key_ratio`, of two values made by :func:`key_form`."""
    la, lb = F.length(a["key"]), F.length(b["key"])
    lcs = F.when(la <= WORD_BITS, _lcs_of_forms(a, b)).when(lb <= WORD_BITS, _lcs_of_forms(b, a)).otherwise(
        _lcs_many_words(F.when(la >= lb, a["key"]).otherwise(b["key"]), F.when(la >= lb, b["key"]).otherwise(a["key"]))
    )
    return (
        F.when((la == 0) | (lb == 0), 0)
        .when(a["key"] == b["key"], 100)
        .otherwise(F.bround(F.lit(200.0) * lcs / (la + lb), 0).cast("int"))
    )


# Kinds of characters counted in a key: texts whose counts agree share an upper bound of the ratio.
KINDS = (" ", "[0-9]", "_", "[a-d]", "e", "[f-l]", "[m-p]", "[q-s]", "[t-z]")


def kind_counts(key: Column) -> Column:
    return F.array(*[F.regexp_count(key, F.lit(kind)) for kind in KINDS])


def counts_bound(a: Column, b: Column) -> Column:
    """The highest score of two keys with these :func:`kind_counts`."""
    total = lambda counts: F.aggregate(counts, F.lit(0), lambda acc, n: acc + n)
    common = total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    length = total(a) + total(b)
    return F.when(length == 0, 0).otherwise(F.bround(F.lit(200.0) * common / length, 0).cast("int"))


def reachable(a: Column, b: Column, min_confidence: float) -> Column:
    """False where the lengths alone rule out ``min_confidence``; exact, so safe as a filter."""
    la, lb = F.length(a), F.length(b)
    return F.lit(200.0) * F.least(la, lb) >= (la + lb) * F.lit(float(min_confidence) - 0.5)


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    keys = F.array(token_sort_key(a), token_sort_key(b))
    return _let(keys, lambda pair: key_ratio(F.element_at(pair, 1), F.element_at(pair, 2)))
