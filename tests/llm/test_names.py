"""Own columns with the names that the operators use inside change nothing."""

import pytest

from tidewatch.llm import bpe, decontaminate, embedding_dups, language_id, licenses, line_dedup, near_dups, suffix_dedup, token_counts

NAMES = ["id", "gone", "gone_", "mark", "at", "seed", "n", "band", "label", "component", "v", "side", "doc", "spans", "tokens", "t", "shift", "sig", "set_key", "__key", "__text", "first", "last", "item", "words", "node", "h", "l"]
RUN = "\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(4))
ROWS = [(1, RUN), (2, f"head\n{RUN}\ntail"), (3, "All rights reserved."), (4, None), (5, ""), (2, f"head\n{RUN}\ntail"), (None, RUN)]
ITEMS = [(7, " ".join(RUN.split()[:20]))]


def frame(spark, rows, schema, extra):
    names = [c for c in extra if c not in schema]
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema + "".join(f", {c} int" for c in names))


CASES = {
    "encode": lambda s, x: bpe.encode(frame(s, ROWS, "doc_id long, text string", x)),
    "round_trip": lambda s, x: bpe.digests(bpe.round_trip(frame(s, ROWS, "doc_id long, text string", x))),
    "count_tokens": lambda s, x: token_counts.count_tokens(frame(s, ROWS, "doc_id long, text string", x)),
    "identify": lambda s, x: language_id.identify(frame(s, ROWS, "doc_id long, text string", x), language_id.fit(["the of", "der die"] * 9, ["en", "de"] * 9)),
    "near_duplicates": lambda s, x: near_dups.near_duplicates(frame(s, ROWS, "doc_id long, text string", x)),
    "dedup_lines": lambda s, x: line_dedup.dedup_lines(frame(s, ROWS, "doc_id long, text string", x)),
    "overlaps": lambda s, x: decontaminate.overlaps(frame(s, ROWS, "doc_id long, text string", x), frame(s, ITEMS, "item_id long, text string", x)),
    "decontaminate": lambda s, x: decontaminate.decontaminate(frame(s, ROWS, "doc_id long, text string", x), frame(s, ITEMS, "item_id long, text string", x)),
    "near_vectors": lambda s, x: embedding_dups.near_vectors(frame(s, [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None)], "vec_id long, embedding array<float>", x)),
    "scan_licenses": lambda s, x: licenses.scan_licenses(frame(s, ROWS, "doc_id long, text string", x)),
    "remove_repeats": lambda s, x: suffix_dedup.remove_repeats(frame(s, ROWS, "doc_id long, text string", x)),
}


@pytest.mark.parametrize("name", CASES)
def test_own_columns_do_not_clash(spark, name):
    bare, full = CASES[name](spark, []), CASES[name](spark, NAMES)
    assert [c for c in full.columns if c not in NAMES] == [c for c in bare.columns if c not in NAMES]
    shown = lambda df: sorted(repr([r[c] for c in bare.columns]) for r in df.collect())
    got = shown(bare)
    assert got and shown(full) == got
