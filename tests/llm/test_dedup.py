import hashlib
from collections import defaultdict

from reelframe.llm import dedup


def norm(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    out = []
    for r in rows:
        own = groups[norm(r[1])]
        best = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        out.append((r[0], best[0], len(own), hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_rows_match_brute_force(docs, rows):
    got = dedup.exact_dedup(docs, digest_all=True).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=str) == expected(rows)
    assert sum(r.kept for r in got) == len({norm(r[1]) for r in rows})
    assert all(r.kept for r in got if r.group_size == 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_survivors_only_mode_agrees(docs):
    whole = dedup.exact_dedup(docs, digest_all=True).drop("digest", "kept")
    part = dedup.exact_dedup(docs)
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.drop("digest", "kept").collect()))
    assert part.where("digest is null and group_size > 1").count() == 0
    assert part.where("kept").count() == dedup.exact_dedup(docs, digest_all=True).where("kept").count()


def test_drop_keeps_one_row_a_text_with_all_columns(docs, rows):
    kept = dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len({norm(r[1]) for r in rows}) == len({norm(r.text) for r in got})
    assert sorted(str(r.doc_id) for r in got) == sorted({str((e[1], e[3])): str(e[1]) for e in expected(rows)}.values())


def test_empty_table(none):
    assert dedup.exact_dedup(none).count() == dedup.exact_dedup(none, digest_all=True).count() == dedup.drop_exact_copies(none).count() == 0


def test_the_stage_hashes_survivors_only(docs, monkeypatch):
    seen = []
    monkeypatch.setattr(dedup, "table", lambda df, name, write=dedup.table: (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())), write(df, name))[1])
    plan = dedup.drop_exact_copies(docs)._jdf.queryExecution().optimizedPlan().toString()
    made = dict(seen)
    assert "sha2" not in made["dedup_signature"] and "LeftSemi" in made["dedup_hashed"]
    assert "CASE WHEN isnotnull(k_len" in plan.replace("`", "")
