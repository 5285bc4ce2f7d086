"""DataFrame -> DataFrame operators (lazy: no action unless documented)."""
