"""Column functions: dates, money, classification, rates."""
