"""Calls of servers that are asked again."""

from __future__ import annotations

import random
import time
import urllib.error


def with_retries(call, retries: int = 3, busy_delay: float = 60.0, delay: float = 10.0, sleep=time.sleep):
    """call() again after 429 (busy_delay) and 5xx or network errors (delay), each times the attempt and up to 10 % more; other errors rise."""
    for attempt in range(1, retries + 2):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if attempt > retries or (e.code != 429 and e.code < 500):
                raise
            pause = busy_delay if e.code == 429 else delay
        except (urllib.error.URLError, TimeoutError):
            if attempt > retries:
                raise
            pause = delay
        sleep(pause * (1 + 0.1 * random.random()) * attempt)
