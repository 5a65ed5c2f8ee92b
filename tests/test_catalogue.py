import inspect

from strataline.plans import catalogue


def test_operations_are_documented_functions():
    assert len(catalogue.OPERATIONS) > 60
    for name, f in catalogue.OPERATIONS.items():
        assert "." in name and callable(f) and inspect.signature(f)
    assert catalogue.find("mt.") and not catalogue.find("no such")
