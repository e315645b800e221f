"""The package is sent to the executors once, whoever asks first."""

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from shelfcast.session import ship_package


def test_fits_side_by_side_send_one_archive():
    sent = []

    def add(path):
        time.sleep(0.05)
        sent.append(path)

    spark = SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=add))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: ship_package(spark), range(7)))
    assert len(sent) == 1
    ship_package(spark)
    assert len(sent) == 1
