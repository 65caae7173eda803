from basketweave.llm import chunks


def test_a_value_goes_when_a_task_did_not_ask_for_it():
    made = []
    make = lambda: made.append(1) or object()
    first = chunks.worker_value("test-memory", make)
    chunks.end_task()
    assert chunks.worker_value("test-memory", make) is first  # the next task of the same step
    chunks.end_task()
    chunks.end_task()  # a task of another step
    assert chunks.worker_value("test-memory", make) is not first and len(made) == 2
