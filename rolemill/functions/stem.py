"""Porter stemming of token arrays (M. F. Porter, 1980)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: suffix rules of the published algorithm ---
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
         ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
         ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
         ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
         ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
         "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word

    def shape(w):
        """Consonant/vowel pattern; y after a consonant is a vowel."""
        out = ""
        for ch in w:
            vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
            out += "v" if vowel else "c"
        return out

    def measure(w):
        return shape(w).count("vc")

    def cvc(w):
        return shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def doubled(w):
        return len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c"

    def swap(w, rules):
        for suffix, other in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                base = w[:-len(suffix)]
                return base + other if measure(base) > 0 else w
        return w

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in shape(w[:-len(suffix)]):
                w = w[:-len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif doubled(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"

    w = swap(swap(w, STEP2), STEP3)

    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[:-len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break

    if w.endswith("e"):
        base = w[:-1]
        if measure(base) > 1 or (measure(base) == 1 and not cvc(base)):
            w = base
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stems of token arrays. A worker stems a word once, so the vocabulary
    needs no join and a frequent word causes no skew. Tokens stay in Arrow: only a
    batch's distinct words become Python strings."""
    seen = {None: None}

    def known(word):
        if word not in seen:
            if len(seen) > 500_000:
                seen.clear()
                seen[None] = None
            seen[word] = stem(word)
        return seen[word]

    for tokens in batches:
        words = tokens.flatten().dictionary_encode()
        stems = pa.array(map(known, words.dictionary.to_pylist()), pa.string()).take(words.indices)
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int64()).to_numpy()
        ends = pa.array(np.concatenate(([0], sizes.cumsum())), pa.int32())
        yield pa.ListArray.from_arrays(ends, stems, mask=tokens.is_null())
