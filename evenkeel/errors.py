class BalanceError(ValueError):
    """What a call asks for can't be done with the data or parameters given."""
