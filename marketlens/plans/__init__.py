"""Query plans: views (W), questions (Q), checks (V), star model (M), measures (K)."""
