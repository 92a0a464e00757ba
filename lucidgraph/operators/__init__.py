"""Graph operators: statistics, slices, pattern mining, deduction, feedback, evaluation, clustering, embedding."""
