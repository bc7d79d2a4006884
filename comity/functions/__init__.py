"""Column functions: text cleaning, linguistic rules, casts, video ids."""
