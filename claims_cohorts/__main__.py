"""``python -m claims_cohorts``: same as ``python -m claims_cohorts.cli``."""

from claims_cohorts.cli import main

if __name__ == "__main__":
    main()
