"""The licence classifier: what it is trained on, what calibrates it, and what it makes of notices it has not seen."""

from siftline.llm import licenses


def test_licence_classes_are_calibrated_on_texts_that_are_not_trained_on():
    trained, held = licenses.training_examples(), licenses.held_examples()
    texts = {" ".join(sorted(g)) for g, f in trained if f not in (licenses.NONE,)}
    assert not any(n in own for f, own in licenses.NOTICES.items() for n in licenses.HELD_NOTICES[f])
    assert not texts & {" ".join(sorted(licenses._grams(n))) for own in licenses.HELD_NOTICES.values() for n in own}
    assert not set(licenses.HELD_LICENCES) & set(licenses.OTHER_LICENCES)
    m = licenses.model()
    assert all(m.loss(held) <= m.loss(held, t) + 1e-12 for t in (0.5, 1.0, 2.0))
    right = sum(m.families[(p := m.probabilities(g)).index(max(p))] == f for g, f in held)
    assert right >= 0.8 * len(held)
    clean = [g for g, f in held if f == licenses.NONE]
    assert sum(m.probabilities(g)[-1] >= 0.5 for g in clean) >= 0.9 * len(clean)
