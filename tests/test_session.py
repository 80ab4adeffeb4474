"""Session helpers that several threads of a study call at once."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier
from time import sleep
from types import SimpleNamespace

from terraloom.session import ship_package


def test_the_package_is_sent_once_when_threads_ask_together():
    sent, gate = [], Barrier(4)
    context = SimpleNamespace(addPyFile=lambda path: (sleep(0.05), sent.append(path)))

    def ask(_):
        gate.wait()
        ship_package(SimpleNamespace(sparkContext=context))

    with ThreadPoolExecutor(4) as workers:
        list(workers.map(ask, range(4)))
    assert len(sent) == 1
