"""Complete plans: cleaning, completion, checks, metrics and derived results."""
