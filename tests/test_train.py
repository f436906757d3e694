import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import batching
from tandem.plans import train as tr

RNG = np.random.default_rng(1)
N = 60
XS = [RNG.normal(size=(N, 4)), RNG.normal(size=(N, 3))]
Y = (XS[0][:, 0] + XS[1][:, 1] > 0).astype(float) + (XS[0][:, 2] > 1)


def table(spark, parts=3):
    rows = [(i, float(Y[i]), 1.0, XS[0][i].tolist(), XS[1][i].tolist()) for i in range(N)]
    return spark.createDataFrame(rows, "id bigint, y double, w double, vec_1 array<double>, vec_2 array<double>").repartition(parts)


@pytest.mark.parametrize("method,norm", [("concat", False), ("concat", True), ("mean", False), ("mean", True), ("dme", False), ("dme", True)])
@pytest.mark.parametrize("outputs", [1, 3])
@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradient_matches_finite_differences(method, norm, outputs, dropout):
    spec = tr.HeadSpec([4, 3], outputs, method, norm, dropout)
    p = spec.init(2)
    w = RNG.random(N)
    mask = tr.dropout_mask(np.arange(N), spec.meta_width, dropout, 9) if dropout else None
    _, g = tr.forward_backward(spec, p, XS, Y, w, mask)
    assert set(g) == set(p)
    for name, a in p.items():
        flat = a.ravel()
        for i in {0, flat.size // 2, flat.size - 1}:
            keep, e = flat[i], 1e-6
            flat[i] = keep + e
            up, _ = tr.forward_backward(spec, p, XS, Y, w, mask, False)
            flat[i] = keep - e
            down, _ = tr.forward_backward(spec, p, XS, Y, w, mask, False)
            flat[i] = keep
            assert np.ravel(g[name])[i] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-5)


def test_partitions_do_not_change_the_gradient(spark):
    spec = tr.HeadSpec([4, 3], 3, "dme", True, 0.2)
    p = spec.init(0)
    want = tr.forward_backward(spec, p, XS, Y, np.ones(N), tr.dropout_mask(np.arange(N), 4, 0.2, 5))
    for parts in (1, 4):
        loss, weight, g = tr.summed_gradient(table(spark, parts), spec, p, seed=5)
        assert weight == N and loss == pytest.approx(want[0], abs=1e-9)
        assert all(np.allclose(g[n], want[1][n], atol=1e-9) for n in p)


def test_dropout_keeps_the_expected_share():
    m = tr.dropout_mask(np.arange(2000), 50, 0.3, 1)
    assert (m == 0).mean() == pytest.approx(0.3, abs=0.01) and m.mean() == pytest.approx(1.0, abs=0.02)


def test_fit_learns_keeps_the_best_epoch_and_scores_like_the_plan(spark):
    t = table(spark)
    result = tr.fit(t, tr.HeadSpec([4, 3], 3, "dme"), dev=t, test=t, metrics=["accuracy", "matthews_corr"], epochs=6, learning_rate=0.1)
    losses = [h[1] for h in result.history]
    assert losses[-1] < losses[0] and len(result.history) == 6
    scores = [h[3] for h in result.history]
    assert result.best_epoch == scores.index(max(scores)) + 1
    assert dict(result.test)["accuracy"] == pytest.approx(max(scores))
    assert result.history_table(spark).count() == 6


def epoch_order(ids, epoch, seed):
    if epoch == 1:
        return sorted(ids)
    return sorted(ids, key=lambda k: hashlib.md5(f"{seed}:{epoch}:{k}".encode()).hexdigest())


def test_a_step_reads_the_files_of_its_own_batch(spark):
    store = tr.StepStore(table(spark), 16, 2, 3)
    want = epoch_order(range(N), 2, 3)
    for k in range(4):
        rows = store.step(k)
        assert sorted(r.id for r in rows.collect()) == sorted(want[16 * k : 16 * k + 16])
        assert all(f"/batch_id={k}/" in f for f in rows.inputFiles())
    store.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.step(0).count()


@pytest.mark.parametrize(("method", "dropout", "batch", "parts"), [("concat", 0.0, 16, 1), ("dme", 0.2, 7, 5), ("mean", 0.0, 60, 3)])
def test_training_equals_a_plain_loop(spark, method, dropout, batch, parts):
    """Fixed batches in epoch order, the mean of dev batches, the schedule: against numpy alone."""
    spec = tr.HeadSpec([4, 3], 3, method, dropout=dropout)
    settings = dict(epochs=3, batch_size=batch, learning_rate=0.05, use_linear_scheduler=True, seed=2)
    t = table(spark, parts)
    got = tr.fit(t, spec, dev=t, **settings)
    p, optimizer, steps, history, k = spec.init(2), tr.AdamW(), -(-N // batch) * 3, [], 0
    for epoch in (1, 2, 3):
        order, losses = epoch_order(range(N), epoch, 2), []
        for lo in range(0, N, batch):
            own = np.array(order[lo : lo + batch])
            mask = tr.dropout_mask(own, spec.meta_width, dropout, 2 * 1_000_003 + k) if dropout else None
            loss, g = tr.forward_backward(spec, p, [x[own] for x in XS], Y[own], np.ones(len(own)), mask)
            rate = 0.05 * tr.schedule_factor(k, steps, int(np.ceil(steps * 0.1)))
            optimizer.update(p, {n: a / len(own) for n, a in g.items()}, lambda n: rate)
            losses.append(loss / len(own))
            k += 1
        dev = [tr.forward_backward(spec, p, [x[lo : lo + batch] for x in XS], Y[lo : lo + batch], np.ones(len(Y[lo : lo + batch])), None, False)[0] / len(Y[lo : lo + batch]) for lo in range(0, N, batch)]
        history.append((epoch, np.mean(losses), np.mean(dev)))
    for n in p:
        assert np.allclose(got.params[n], p[n], atol=1e-9), n
    assert [h[:3] for h in got.history] == [pytest.approx(h, abs=1e-9) for h in history]
    assert got.progress_table(spark, 2, 2).agg(F.sum("n")).first()[0] == -(-N // batch)


def test_gradients_of_many_partitions_are_added_in_groups(spark):
    spec = tr.HeadSpec([4, 3], 3, "concat")
    p = spec.init(0)
    want = tr.forward_backward(spec, p, XS, Y, np.ones(N))
    loss, weight, g = tr.summed_gradient(table(spark, tr.GROUPS + 9), spec, p)
    assert weight == N and loss == pytest.approx(want[0], abs=1e-9)
    assert all(np.allclose(g[n], want[1][n], atol=1e-9) for n in p)


TAGS = {"O": 0, "B-X": 1, "I-X": 2}


def tagged(spark, n, seed):
    """Sentences of words whose vectors tell their tags, with some noise; a third of the sentences have one word."""
    draw = np.random.default_rng(seed)
    rows = []
    for sent in range(n):
        size = 1 if sent % 3 == 0 else int(draw.integers(2, 9))
        tag = 0
        for at in range(size):
            tag = int(draw.choice([0, 1, 2] if tag else [0, 1]))
            rows.append((sent * 100 + at, float(tag), 1.0 / size, sent, at, (np.eye(3)[tag] + 0.45 * draw.normal(size=3)).tolist()))
    return rows, spark.createDataFrame(rows, "id bigint, y double, w double, sent bigint, word_pos int, vec_1 array<double>").repartition(4)


def entity_f1(sequences):
    def spans(tags):
        found, begin = set(), None
        for i, t in enumerate([*tags, "O"]):
            if begin is not None and t != "I-X":
                found.add((begin, i))
                begin = None
            if t == "B-X" or (t == "I-X" and begin is None):
                begin = i
        return found

    hit = gold = pred = 0
    for g, q in sequences:
        a, b = spans(g), spans(q)
        hit, gold, pred = hit + len(a & b), gold + len(a), pred + len(b)
    return 2 * hit / (gold + pred)


def test_tagger_keeps_sentences_together_and_is_scored_by_spans(spark):
    rows, train = tagged(spark, 60, 1)
    store = tr.StepStore(train, 16, 2, 0)
    order = epoch_order(range(60), 2, 0)
    for k in range(4):
        assert sorted(r.id for r in store.step(k).collect()) == sorted(r[0] for r in rows if r[3] in order[16 * k : 16 * k + 16])
    dev_rows, dev = tagged(spark, 40, 2)
    test_rows, test = tagged(spark, 40, 3)
    result = tr.fit(
        train, tr.HeadSpec([3], 3), dev=dev, test=test, metrics=["f1_score", "accuracy"], tags=TAGS, epochs=4, batch_size=16, learning_rate=0.2
    )
    names = list(TAGS)

    def sequences(rows, p):
        out = {}
        for _, y, _, sent, _, v in rows:
            guess = int(np.argmax(p["dec_w"] @ np.array(v) + p["dec_b"]))
            out.setdefault(sent, ([], []))
            out[sent][0].append(names[int(y)])
            out[sent][1].append(names[guess])
        return list(out.values())

    scores = [h[3] for h in result.history]
    assert result.best_epoch == scores.index(max(scores)) + 1
    assert max(scores) == pytest.approx(entity_f1(sequences(dev_rows, result.params)))
    found = sequences(test_rows, result.params)
    assert dict(result.test)["f1_score"] == pytest.approx(entity_f1(found))
    pairs = [(a, b) for g, q in found for a, b in zip(g, q, strict=True)]
    assert dict(result.test)["accuracy"] == pytest.approx(np.mean([a == b for a, b in pairs]))
    assert 0.3 < dict(result.test)["f1_score"] < 1


def test_no_training_rows_and_given_first_parameters(spark):
    spec = tr.HeadSpec([4, 3], 3)
    first = spec.init(7)
    none = tr.fit(table(spark).limit(0), spec, epochs=2, batch_size=4, init=first)
    assert [h[1] for h in none.history] == [None, None]
    assert all((none.params[n] == first[n]).all() for n in first)


def test_rates_by_group():
    spec = tr.HeadSpec([4, 3], 2, "dme")
    rate = tr.group_rates(spec, [0.1, 0.2], None)
    assert (rate("proj_w0"), rate("proj_b1"), rate("attn_w"), rate("dec_w")) == (0.1, 0.2, 0.1, 0.1)
    assert tr.group_rates(spec, 0.1, 0.5)("dec_b") == 0.5
    with pytest.raises(ValueError):
        tr.group_rates(spec, [0.1, 0.2, 0.3], None)


def test_adamw_first_step_and_clipping():
    p, opt = {"x": np.array([1.0])}, tr.AdamW(weight_decay=0.01)
    opt.update(p, {"x": np.array([100.0])}, lambda n: 0.1)
    assert p["x"][0] == pytest.approx(1.0 * (1 - 0.001) - 0.1, abs=1e-6)
    assert opt.m["x"][0] == pytest.approx(0.5, abs=1e-6)


def test_schedule_table_equals_the_rule(spark):
    plan = batching.batch_plan(spark.range(33), 16, 10, 0.1)
    got = [r.lr for r in tr.lr_schedule(plan, 2.0).orderBy("step").collect()]
    assert got == pytest.approx([2.0 * tr.schedule_factor(s, 30, 3) for s in range(30)]) and got[0] == 0.0


def test_xavier_bound():
    p = tr.HeadSpec([4, 3], 5, "concat").init(0)
    assert np.abs(p["dec_w"]).max() <= np.sqrt(6 / 12)
