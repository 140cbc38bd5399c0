"""Tasks share what they ask for, and drop what they don't."""

from stateweave.llm import worker


def big(size):
    return [size]


def test_shared_until_a_task_does_not_ask():
    first = worker.prepared(lambda: worker.shared(big, 3))
    assert worker.prepared(lambda: worker.shared(big, 3)) is first
    both = worker.prepared(lambda: (worker.shared(big, 3), worker.shared(big, 4)))
    assert both[0] is first and len(worker._held) == 2
    worker.prepared(lambda: worker.shared(big, 4))
    assert len(worker._held) == 1
    worker.prepared(lambda: None)
    assert not worker._held
    assert worker.prepared(lambda: worker.shared(big, 3)) is not first
